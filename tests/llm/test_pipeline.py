"""Every stage against a plain version of its decisions, on a small table with planted cases."""

import hashlib
import random

from pyspark.sql import functions as F
from test_texts import brute_fingerprint, prose

import corpus_pipeline as cp
from sluice.llm import simhash


def docs_of(documents):
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(30, 200)), "aa", f"s{i % 3}") for i in range(80)]
    near = rows[3][1].split()
    near[50 % len(near)] = "changed"
    rows += [(100, rows[3][1], "aa", "s0"), (101, rows[3][1], "aa", "s1"), (102, " ".join(near), "aa", "s1"), (103, None, "aa", "s0"), (104, "123 !", None, "s2"), (105, "", "aa", None), (106, prose(rng, 60), None, "s1")]
    return documents(rows)


def test_stages(spark, documents, sf_dir):
    docs = docs_of(documents)
    assert [n for n, _ in cp.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    one = cp.identify_language(spark, docs, sf_dir)
    kept = {r["doc_id"]: r for r in one.collect()}
    assert one.columns == list(cp.COLUMNS) and set(kept) == {*range(80), 100, 101, 102, 106} and kept[106]["lang"] == "aa"
    two = cp.near_dedup(spark, one, sf_dir)
    texts = {i: r["text"] for i, r in kept.items()}
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t in texts.items()}
    at = {i: min(j for j in texts if simhash.jaccard(sets[i], sets[j]) >= 0.8) for i in texts}
    assert two.columns == list(cp.COLUMNS) and {r["doc_id"] for r in two.collect()} == set(at.values()) and 102 not in set(at.values())
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    leaked = two.unionByName(documents([(500, "kato " + item + " misu", "aa", "s1")]).select(*two.columns))
    three = cp.decontaminate(spark, leaked, sf_dir)
    assert {r["doc_id"] for r in three.collect()} == set(at.values())
    four = cp.mix(spark, three, sf_dir)
    counts = {}
    for r in four.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert four.columns == list(cp.COLUMNS) and set(counts) <= set(at.values()) and max(counts.values()) <= 2 and sum(counts.values()) > len(at) * 0.9
    five = cp.shard(spark, four, sf_dir).collect()
    assert len(five) == sum(counts.values()) and {r["shard"] for r in five} <= set(range(16))
    assert brute_fingerprint("") == 0


def test_run_and_odd_tables(spark, documents, sf_dir):
    assert cp.run(spark, sf_dir).count() > 50
    empty = documents([]).select(*cp.COLUMNS)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
    twice = documents([(1, "kato misu nare", "aa", "s"), (1, "kato misu nare", "aa", "s"), (None, "kato", "aa", None)]).select(*cp.COLUMNS)
    assert cp.near_dedup(spark, twice, sf_dir).count() == 2
    assert cp.mix(spark, twice, sf_dir).count() == 0  # four words are less than half a block


def test_documents_without_an_id_of_their_own(spark, documents, sf_dir):
    """Null and repeated ids: only copies, near copies and leaks go, one row a group stays."""
    rng = random.Random(22)
    texts = [prose(rng, 120) for _ in range(12)]
    words = texts[0].split()
    near = " ".join([*words[:60], "new", *words[61:]])
    rows = [(None, t, "aa", "s0") for t in texts[:4]] + [(7, t, "aa", "s0") for t in texts[4:8]] + [(7, texts[4], "aa", "s0"), (3, near, "aa", "s0"), (None, texts[5], "aa", "s0")]
    docs = documents(rows).select(*cp.COLUMNS)
    kept = cp.near_dedup(spark, docs, sf_dir)
    want = sorted([("None", t) for t in texts[1:4]] + [("7", t) for t in texts[4:8]] + [("3", near)])
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == want
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    leaked = kept.unionByName(documents([(7, "kato " + item, "aa", "s0"), (None, item + " misu", "aa", "s0")]).select(*cp.COLUMNS))
    clean = cp.decontaminate(spark, leaked, sf_dir)
    assert sorted((str(r["doc_id"]), r["text"]) for r in clean.collect()) == want
    # one row a document: what the mix takes of one under an id says nothing of another
    ratios = cp.mixing.mix_sources(clean.withColumn("row", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("text"), "source")), id_col="row").collect()
    counts = {}
    for r in cp.mix(spark, clean, sf_dir).collect():
        key = f"{'null' if r['doc_id'] is None else r['doc_id']}|{hashlib.md5(r['text'].encode()).hexdigest()}|{r['source']}"
        counts[key] = counts.get(key, 0) + 1
    assert counts == {r["row"]: n for r in ratios if (n := int(r["taken"] / r["size"] + 0.5))}
