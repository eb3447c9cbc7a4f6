"""Cases that earlier versions of the corpus operators lost."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from lodecat.llm import chat, itq, mixing, pii  # noqa: E402


def test_chat_finds_rewrites_that_are_undone():
    turns = [("user", f"t{k}") for k in range(90)]
    brief = lambda t: chat.inst_template([("user", "new"), *t[1:]] if 40 <= len(t) < 50 else t)
    assert chat.render(turns, brief) == chat.render(turns, brief, window=1000) and chat.render(turns, brief).rewrites == 39


def _links(spark, u):
    rows = [(i, x.tolist()) for i, x in enumerate(u)]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    near = u @ u.T >= 0.95
    return sum(r["n_links"] for r in got.select("n_links").collect()), int(near.sum()) - len(u)


def _skewed(share, n=3000, dim=32):
    """Pairs a little above the threshold; all vectors share a mean of this squared length."""
    r = np.random.default_rng(7)
    a = r.standard_normal((n, dim))
    a[:, 0] = 0
    a *= np.sqrt(1 - share) / np.linalg.norm(a, axis=1, keepdims=True)
    a[:, 0] = np.sqrt(share)
    noise = r.standard_normal((n // 2, dim))
    b = a[:n // 2]
    noise -= (noise * b).sum(1, keepdims=True) * b
    b = 0.953 * b + np.sqrt(1 - 0.953 ** 2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    return np.concatenate([a, b])


def test_embeddings_with_a_shared_mean_keep_their_links(spark):
    for share in (0.5, 0.7):
        found, there = _links(spark, _skewed(share))
        assert there > 2500 and found >= 0.97 * there


def test_tables_follow_the_centred_angle():
    assert itq.tables_for(10**4, 8, 0.95, 0.01) == (8, 9)
    for radius in (1.0, 0.7, 0.5, 0.3):
        for rows in (10**3, 10**6, 10**8):
            bits, tables = itq.tables_for(rows, None, 0.95, 0.01, radius)
            agree = 1 - 2 * np.arcsin(0.1 ** 0.5 / 2 / radius) / np.pi
            assert (1 - agree ** bits) ** tables <= 0.01 and tables <= itq.TABLES
    assert itq.tables_for(10**6, None, 0.95, 0.01, 0.1) == (0, 1) == itq.tables_for(10**6, None, 0.95, 0.01, 0.0)


def test_accounts_in_groups_long_runs_and_mixed_case():
    def account(text):
        return [text[a:b] for k, a, b in pii.spans_of(text) if k == "account"]
    for code in ("GB29 NWBK 6016 1331 9268 19", "NL91 ABNA 0417 1643 00", "IE29 AIBK 9311 5212 3456 78", "BG80 BNBG 9661 1020 3456 78",
                 "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "GB29NWBK60161331926819", "DE89 3704 0044 0532 0130 00"):
        assert account(f"é IBAN: {code} and more") == [code]
        assert account(f"iBan {code}, 12") == [code]
    assert account("IBAN: GB29 NWBK 6016 1331 9268 18 no") == []
    assert account("User ID: 48210394.") == ["48210394"] == account("É Customer ID: 48210394")
    long = "1234567890" * 7
    assert account(f"account: {long} x") == [long] and pii.redact(f"account: {long} x", pii.spans_of(f"account: {long} x")) == "account: [ACCOUNT] x"


def test_embeddings_in_batches_of_several_pieces(spark):
    u = np.random.default_rng(3).standard_normal((10_000, 64))
    u[5000:] = u[:5000] * 2
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "vec_id long, embedding array<double>")
    got = itq.near_duplicates(rows.coalesce(1), sample_rows=500).select("vec_id", "component_id", "n_links").collect()
    assert len(got) == 10_000 and all(r["n_links"] == 1 and r["component_id"] == r["vec_id"] % 5000 for r in got)


def test_mix_without_budget_holds_documents_without_words(spark):
    rows = [(i, " " if i % 3 else "a b c", "large") for i in range(60)] + [(100, "a", "small"), (101, None, "none"), (102, "", "none"), (103, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for entropy in (0.0, 0.95):
        got = mixing.mix_sources(docs, entropy_share=entropy)[0].select("row.doc_id", "pass", "block").collect()
        first = [r["doc_id"] for r in got if r["pass"] == 0]
        assert sorted(first) == sorted(r[0] for r in rows) and all(r["block"] is not None for r in got)
    assert mixing.mix_sources(docs.filter("doc_id > 100"))[0].count() == 3
    assert mixing.mix_sources(docs.filter("doc_id > 100"), budget=5)[0].count() == 0
