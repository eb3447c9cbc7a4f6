"""The corpus operators against plain versions, and their defined cases."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import brute  # noqa: E402

from lodecat.llm import bpe, chat, common, itq, mixing, pii, prefix_counts, quality, repeats, simhash, sketch  # noqa: E402
from lodecat.llm.queries import ORACLES, QUERIES  # noqa: E402
from lodecat.llm.vocabulary import file_of  # noqa: E402
from tools.check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
SHARED = "this passage of more than fifty bytes stands in several of the documents here. "


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, copies, near copies, and clashing column names."""
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, None), (6, ""), (7, "  \n "), (8, "one two"), (9, "one two"), (10, LONG), (11, base), (12, base),
            (13, base + " tail"), (14, SHARED + "alpha"), (15, "beta " + SHARED), (16, "x" + SHARED * 3),
            (17, "mail a.b@c.de or +1 (234) 555-0000, 10.0.0.255, 4111 1111 1111 1111"), (17, "mail again z@y.xx"), (None, "no id " + SHARED)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("lang", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("fp", "row", "h", "n_tokens", "block", "host", "tokens", "a")]])
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else f"s{k % 3}", "en", *["own"] * 8) for k, (i, t) in enumerate(rows)], schema)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]).startswith("ok")


def test_top_k_query_takes_every_query(spark):
    rows = QUERIES["op11_block_pruned_top_k"](spark, SF)
    wanted = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert rows.count() == 5 * wanted and rows.select("query_id").distinct().count() == wanted


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - {"op11_block_pruned_top_k"}))
def test_query_takes_every_row(spark, name):
    rows = QUERIES[name](spark, SF)
    key = next(c for c in ("doc_id", "vec_id", "conv_id") if c in rows.columns)
    table = {"doc_id": "documents", "vec_id": "embeddings", "conv_id": "conversations"}[key]
    wanted = spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count() + (key == "conv_id")
    assert rows.select(key).distinct().count() == wanted


@pytest.mark.parametrize("call", [
    pii.find_personal_data, bpe.encode, prefix_counts.token_counts, sketch.compare_edits, repeats.remove_repeats, simhash.near_duplicates,
    repeats.maximal_repeats, lambda d: mixing.mix_sources(d)[0], lambda d: quality.judge(d, None, F.col("source"), F.col("lang"))])
def test_empty_table(docs, call):
    assert call(docs.limit(0)).count() == 0


# 1 ------------------------------------------------------------------------------------------
def test_chat_round_trip_of_control_strings():
    r = random.Random(1)
    parts = [*chat.CONTROL, "\\", "\n", "a", "[", "<", "/", " "]
    for _ in range(500):
        turns = [(r.choice(["user", "assistant", "system", "we[INST]ird\nrole"]), "".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for _ in range(r.randint(0, 5))]
        done = chat.render(turns)
        assert chat.read_back(done.formatted) == turns and done.rewrites == -1
        assert [chat.unescape(done.formatted[a:b]) for _, _, a, b in done.spans] == [t for _, t in turns]
        assert "".join(done.formatted[a:b] for a, b, _, _ in done.spans) == done.formatted[3:]


def test_chat_finds_rewritten_history():
    turns = [("system", "be brief"), ("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.render(turns, chat.last_system_template).rewrites == 3
    assert chat.render(turns).rewrites == -1


def test_chat_long_conversations_equal_whole_prefixes():
    r = random.Random(4)
    turns = [(r.choice(["user", "assistant", "system"]), r.choice(["", "a", "[INST] b", "0", "1\\"])) for _ in range(90)]
    assert chat.render(turns) == chat.render(turns, window=1000)
    far = lambda t: chat.inst_template(t) if len(t) < 60 else chat.inst_template([("user", "new"), *t[1:]])
    assert chat.render(turns, far) == chat.render(turns, far, window=1000) and chat.render(turns, far).rewrites == 59
    many = [("user", "x" * 50)] * 3000
    assert chat.read_back(chat.render(many).formatted) == many


def test_chat_nulls_ties_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", None, 9), (1, 0, "user", None, 9), (None, None, None, "x", 9), (2, 1, "assistant", "b", 9), (2, 0, "user", "a", 9)],
                                 "conv_id long, turn long, role string, text string, n_turns long")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(rows)).collect()}
    assert got[1]["turns_sha256"] == brute.sha("user\n\nuser\n\n") and got[1]["n_turns"] == 2
    assert got[None]["turns_sha256"] == brute.sha("\nx\n")
    assert got[2]["turns_sha256"] == brute.sha("user\na\nassistant\nb\n") and got[2]["loss_sha256"] == brute.sha("b")
    assert chat.format_conversations(rows.limit(0)).count() == 0


# 2 ------------------------------------------------------------------------------------------
def test_personal_data_equals_patterns(documents, docs):
    r = random.Random(3)
    parts = ["a", "b.", "@", "1", "55", ".", "4111 1111 1111 1111", "-", " ", "+", "(", ")", "%", "x@y.z", "1.2.3.4", "é", "+1 (234) 555-0000", "９", "²"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [s for s in pii.spans_of(text) if s[0] in pii.BASE] == brute.personal(text)
    for table in (documents, docs):
        want = sorted(brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(t))) for _, t in pairs(table))
        assert sorted(r["base_sha256"] for r in pii.find_personal_data(table).collect()) == want


def test_personal_data_adds_and_redacts():
    text = "see https://a.example/x?y=1. token = \"40ba077d62935af6\" IBAN: DE89 3704 0044 0532 0130 00 done"
    kinds = {k: text[a:b] for k, a, b in pii.spans_of(text)}
    assert kinds["url"] == "https://a.example/x?y=1" and kinds["secret"] == "40ba077d62935af6" and kinds["account"].startswith("DE89")
    assert pii.redact("x a@b.cd y", pii.spans_of("x a@b.cd y")) == "x [EMAIL] y" and pii.redact("", []) == ""


# 3 and 5 ------------------------------------------------------------------------------------
def odd_texts(n=400):
    r = random.Random(5)
    letters = "abcdefgh'   \n\t\r\x1c\x85\xa0 éÉßΣσςİıÅ０9१!?.,$€漢カ가각̈ʼnﬁ�\U0001f600"
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) + r.choice(["", "<|endoftext|>", "<|startoftext|>x", "'re", "   ", "'LL I'Ve"]) for _ in range(n)]
    return [*out, "", "ab" * 2000, "é" * 2000, "'" * 1500, " " * 1500, "ΑΣ ΑΣ. ΣΑΣ"]


def test_bpe_equals_library(documents):
    path = file_of("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.codec(path)
    for text in [*odd_texts(), *[t for _, t in pairs(documents)]]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.text_of(own.encode("naïve words")) == "naïve words "


def test_bpe_rows(docs):
    library = Tokenizer.from_file(file_of("word_bpe_49k.json"))
    rows = bpe.encode(docs).collect()
    want = [library.encode(t, add_special_tokens=False).ids for _, t in pairs(docs)]
    assert sorted(r["ids_sha256"] for r in rows) == sorted(brute.sha(" ".join(map(str, i))) for i in want)
    assert sorted(r["n_tokens"] for r in rows) == sorted(map(len, want))


def test_prefix_counts_equal_library():
    path = file_of("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), prefix_counts.counter(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for k, text in enumerate(odd_texts()):
        assert own.total(text) == count(text)
        if k % 5 == 0 and len(text) < 100:
            assert own.counts(text).tolist() == [count(text[:i + 1]) for i in range(len(text))]


def test_prefix_counts_rows(docs):
    library = Tokenizer.from_file(file_of("byte_bpe_50k.json"))
    rows = prefix_counts.token_counts(docs, budget=100, prefixes=True).collect()
    want = sorted(len(library.encode(t, add_special_tokens=False).ids) for _, t in pairs(docs))
    assert sorted(r["n_tokens"] for r in rows) == want
    for r in rows:
        assert r["over_limit"] == (r["n_tokens"] > 100) and (not r["counts"] or r["counts"][-1] == r["n_tokens"])
        assert r["cut_chars"] == max([i + 1 for i, c in enumerate(r["counts"]) if c <= 100], default=0)


# 4 ------------------------------------------------------------------------------------------
def test_embeddings_equal_brute_force_with_hot_cells(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = r.standard_normal((300, 16))
    v[100:160] = v[0] + 0.05 * r.standard_normal((60, 16))
    v[200:230] = v[1]
    rows = [(i, [float(x) for x in np.float32(x)]) for i, x in enumerate(v)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [1.0, 2.0]), (906, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    deal = common.block_pairs
    monkeypatch.setattr(itq, "block_pairs", lambda df, member, rows: deal(df, member, 16))
    got = {x["vec_id"]: x for x in itq.near_duplicates(table).collect()}
    u = np.float32(v).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    links = [(i, j) for i in range(300) for j in range(i) if near[i, j]]
    want = brute.groups(range(300), links)
    found = sum(got[i]["n_links"] for i in range(300))
    assert all(got[i]["n_links"] <= near[i].sum() - 1 for i in range(300)) and found >= 0.9 * 2 * len(links)
    assert sum(got[i]["component_id"] == want[i] for i in range(300)) >= 295
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 907)) and len(got) == 307
    assert itq.near_duplicates(table.limit(0)).count() == 0


# 6 ------------------------------------------------------------------------------------------
def test_mix_meets_targets(documents):
    source, tokens = F.col("source"), mixing.words(F.col("text"))
    sources = mixing.shares(documents, source, tokens)
    held = {r["source"]: r["tokens"] for r in sources.collect()}
    share = {s: n / sum(held.values()) for s, n in held.items()}

    def entropy(a):
        w = np.array([p ** a for p in share.values()])
        w /= w.sum()
        return -(w * np.log(w)).sum()
    mix = mixing.find_mix(sources, 0.995)
    assert 0 < mix.exponent < 1 and abs(entropy(mix.exponent) - 0.995 * np.log(len(share))) < 1e-4
    tight = mixing.find_mix(sources, 1.0, repetition=1.5)
    assert (max(held.values()) / min(held.values())) ** (1 - tight.exponent) <= 1.5 + 1e-3
    rows, mix = mixing.mix_sources(documents, entropy_share=0.995, block_tokens=20_000)
    got = rows.select("row.doc_id", "source", "tokens", "pass", "block").toPandas()
    assert set(got.doc_id) == {i for i, _ in pairs(documents)} and not got.duplicated(["doc_id", "pass"]).any()
    longest = max(len(t.split()) for _, t in pairs(documents))
    for s, part in got.groupby("source"):
        want = mix.budget * share[s] ** mix.exponent / mix.total
        assert want - 2 <= part.tokens.sum() <= want + longest


def test_mix_defined_cases(docs):
    rows, mix = mixing.mix_sources(docs, block_tokens=10)
    got = rows.select("source", "row.doc_id", "row.block", "tokens").collect()
    assert mix and {r["source"] for r in got} == {None, "s0", "s1", "s2"} and {r["block"] for r in got} == {"own"}
    assert mixing.mix_sources(docs.filter("doc_id in (5, 6)"))[1] is None


# 7 ------------------------------------------------------------------------------------------
def test_sketch_likeness(spark, docs):
    got = sorted(sketch.compare_edits(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["n_chars"]))
    assert len(got) == 15 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    own = {r["doc_id"]: r for r in got}
    assert own[11]["near_next"] == 1.0 and own[11]["fingerprint"] == own[12]["fingerprint"] and own[5]["fingerprint"] == ""
    assert own[8]["edited_sha256"] == brute.sha("one twone"[:6] + "o")
    rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(1000)))], "a string, b string")
    kept = rows.select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    inside, like = kept.select(sketch.containment(F.col("b"), F.col("a")), sketch.likeness(F.col("a"), F.col("b"))).first()
    assert inside == 1.0 and abs(like - 996 / 3996) < 0.05
    both = kept.select(F.explode(F.array("a", "b")).alias("s")).agg(sketch.merged(F.col("s")).alias("m")).first()["m"]
    assert both == kept.first()["a"]


# 8 ------------------------------------------------------------------------------------------
def test_repeats_equal_brute_force(spark):
    r = random.Random(8)
    letters = "ab" + "é"
    passages = ["".join(r.choice("abcdefghijkl ") for _ in range(n)) for n in (49, 50, 51, 80, 200, 700)] + ["ab" * 60, "a" * 130, "\0" * 70]
    rows = []
    for i in range(120):
        text = "".join(r.choice([*passages, "".join(r.choice(letters) for _ in range(20)), r.choice(passages)[r.randint(0, 30):]]) for _ in range(r.randint(0, 6)))
        rows.append((i * 3 % 121, text))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == sorted(brute.repeats(rows))


def test_repeats_defined_cases(docs):
    rows = [(common.NULL_ID if i is None else i, t) for i, t in pairs(docs)]
    got = repeats.remove_repeats(docs).collect()
    own = sorted((common.NULL_ID if x["doc_id"] is None else x["doc_id"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got)
    assert own == sorted(brute.repeats(rows))


def test_maximal_repeats_have_all_occurrences(docs):
    texts = {i: t.encode() for i, t in pairs(docs) if i in (14, 15, 16)}
    found = {}
    for r in repeats.maximal_repeats(docs.filter("doc_id in (14, 15, 16)")).collect():
        found.setdefault((r["repeat_id"], r["length"]), []).append((r["doc_id"], r["start"]))
    assert found
    for (_, n), places in found.items():
        strings = {texts[d][s:s + n] for d, s in places}
        assert len(strings) == 1 and n >= 50 and len(places) >= 2
        (s,) = strings
        everywhere = [(d, p) for d, t in texts.items() for p in range(len(t) - n + 1) if t[p:p + n] == s]
        assert set(places) <= set(everywhere)


def test_intervals_by_hand():
    a, b, n = repeats.intervals(np.array([0, 60, 55, 0, 70]), 50)
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(0, 1, 60), (0, 2, 55), (3, 4, 70)]


# 9 ------------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.pmod(F.xxhash64(F.lit("held"), "_id"), F.lit(4)) == 0
    model = quality.train(docs, labels, held_out=out)
    judged = quality.judge(docs, model, F.col("source"), F.col("lang"), carry=["doc_id"]).select(F.col("row.doc_id").alias("_id"), "keep")
    held = labels.withColumn("_id", F.col("doc_id").cast("long")).filter(out)
    got = judged.join(held, "_id").groupBy((F.col("quality") * (1 - F.col("toxic"))).alias("good")).agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r["good"]: r["kept"] for r in got}
    assert kept[1] >= 0.98 and kept[0] <= 0.1


def test_quality_shrinks_sparse_sites(spark):
    rows = [("a", "a1", 0.9)] * 500 + [("a", "a2", 0.8)] * 500 + [("b", "b1", 0.2)] * 500 + [("c", "c1", 0.0)]
    sites, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    got = {r["path"]: r for r in sites.collect()}
    assert abs(got["a1"]["path_mean"] - 0.9) < 0.02 and abs(got["b1"]["host_mean"] - 0.2) < 0.02
    assert 0 < got["c1"]["host_mean"] <= mean


def test_quality_keeps_all_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None
    rows = quality.judge(docs, None, F.col("source"), F.col("lang")).collect()
    assert len(rows) == 15 and all(r["keep"] and r["row"]["host"] == "own" for r in rows)


# 10 -----------------------------------------------------------------------------------------
def test_simhash_equals_brute_force(spark, docs, documents):
    for table in (docs, documents):
        rows = [(common.NULL_ID if i is None else i, t) for i, t in pairs(table)]
        fp = {k: brute.simhash(t) for k, (_, t) in enumerate(rows)}
        linked = [(rows[a][0], rows[b][0]) for a in fp for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4]
        want = brute.groups({i for i, _ in rows}, linked)
        got = simhash.near_duplicates(table).collect()
        own = lambda i: common.NULL_ID if i is None else i
        assert sorted((own(r["doc_id"]), r["fp"] % (1 << 64)) for r in got) == sorted((i, fp[k]) for k, (i, _) in enumerate(rows))
        assert all(own(r["component_id"]) == want[own(r["doc_id"])] for r in got)


@pytest.mark.parametrize("groups", [5, 6, 8])
def test_simhash_join_loses_no_link_in_hot_cells(spark, groups):
    r = random.Random(groups)
    start = r.getrandbits(64)
    bits = {start}
    while len(bits) < 120:  # a chain of near fingerprints, all in few cells
        x = r.choice(sorted(bits))
        for _ in range(r.randint(1, 5)):
            x ^= 1 << r.randrange(64)
        bits.add(x)
    bits = sorted(bits | {r.getrandbits(64) for _ in range(80)})
    signed = [x - (1 << 64) if x >> 63 else x for x in bits]
    classes = spark.createDataFrame(list(zip(signed, range(len(bits)))), "fp long, rep long")
    cells = common.map_rows(classes, simhash._cells(groups, 4), "cell long, rest int, fp long, rep long")
    links = common.block_pairs(cells, "fp", 10).repartition("cell", "left", "right").mapInArrow(simhash._verify(4), "a long, b long")
    got = {x["node"]: x["root"] for x in common.components(links).collect()}
    want = brute.groups(range(len(bits)), [(a, b) for a in range(len(bits)) for b in range(a) if bin(bits[a] ^ bits[b]).count("1") <= 4])
    assert all(got.get(i, i) == want[i] for i in range(len(bits)))


def test_components_of_long_chains(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)]
    r.shuffle(links)
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[i] == 1000 for i in range(1001, 1200))


# pipeline -----------------------------------------------------------------------------------
def test_pipeline_equals_plain_stages(spark, documents):
    import corpus_pipeline
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs, held = documents.withColumn("fp", F.lit("own")), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        held.append([r.asDict() for r in docs.collect()])
    fit, unique, clean, mixed, coded = held
    own = [(r["doc_id"], brute.shingles(r["text"])) for r in fit]
    root = brute.groups([i for i, _ in own], [(a, b) for k, (a, x) in enumerate(own) for b, y in own[:k] if brute.alike(x, y)])
    assert {r["doc_id"] for r in unique} == set(root.values()) and len(unique) == len(set(root.values()))
    texts = {r["doc_id"]: r["text"] for r in unique}
    assert all(r["text"] == pii.redact(texts[r["doc_id"]], pii.spans_of(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"]) for r in clean)
    assert all(not brute.personal(r["text"]) for r in clean) and all(list(r) == documents.columns + ["fp"] for r in mixed)
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in clean} and len(mixed) >= len(clean)
    library = Tokenizer.from_file(file_of("word_bpe_49k.json"))
    want = sorted((r["doc_id"], brute.sha(" ".join(map(str, library.encode(r["text"], add_special_tokens=False).ids)))) for r in mixed)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in coded) == want
    again = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, again)) == want
