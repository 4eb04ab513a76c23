"""SimHash, language, toxicity, licences, surrogates and leaks against plain versions and planted cases."""

import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import decontam, language, licenses, pii, queries, simhash, toxicity
from sluice.llm.common import table

SYLLABLES = {"a": "ka to mi re su na po li".split(), "b": "schu der ung lich kei ver gen".split()}


def prose(rng, n, kind="a"):
    return " ".join("".join(rng.choices(SYLLABLES[kind], k=rng.randint(1, 3))) for _ in range(n))


# --- SimHash

def brute_fingerprint(text, n=4):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, linked):
    at = list(range(len(values)))

    def root(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return [root(i) for i in range(len(values))]


def test_simhash_against_brute_force(spark, documents):
    rng = random.Random(1)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts = base + [t + " x" for t in base[:30]] + [re.sub(r"^\S+", "Q", t) for t in base[30:50]] + base[:10]
    texts += ["", None, " \t\n", "One", "ÄÖ É x\x0by\xa0z", "ONE", "w " * 5000]
    df = documents(list(enumerate(texts)), extra=True)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    prints = [brute_fingerprint(t) for t in texts]
    roots = groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert got == [(i, f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, roots, strict=True))]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    nulls = simhash.near_duplicates(documents([(None, "a b"), (None, "c"), (3, "a b")])).collect()
    assert sorted(str(r["component_id"]) for r in nulls) == ["3", "3", "None"]


@pytest.mark.parametrize("differ", [4, 7])
def test_links_of_crowded_buckets_keep_components(spark, differ, monkeypatch):
    """Fingerprints close to a few centres: long runs, and buckets that must be split level by level."""
    rng = random.Random(differ)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = set()
    for c in centres:
        for _ in range(120):
            x = c
            for b in rng.sample(range(64), rng.randint(0, differ)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values | {rng.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(0, simhash._signed(v)) for v in values], "bucket long, fp long")
    want = groups(values, lambda a, b: (a ^ b).bit_count() <= differ)
    for few, bucket in ((32, 50_000), (2, 50_000), (2, 25)):
        monkeypatch.setattr(simhash, "FEW", few)
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, differ, bucket)).collect()}
        got = [roots.get(simhash._signed(v), simhash._signed(v)) for v in values]
        assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


@pytest.mark.parametrize("last", [0, 20, 1000])  # contracted to the end, to a few links, and not at all
def test_components_of_long_chains_and_stars(spark, last, monkeypatch):
    monkeypatch.setattr(simhash, "LAST", last)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[1000 + i] for i in range(80)}) == 1 and got[0] != got[1000] and set(got.values()) <= set(got)
    assert simhash.components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0


def test_verified_links(spark, documents):
    rng = random.Random(8)
    a, b = prose(rng, 300), prose(rng, 300)
    words = a.split()
    near, far = " ".join([*words[:150], "new", *words[151:]]), " ".join(w if i % 8 else "new" for i, w in enumerate(words))
    df = documents([(1, a), (2, a), (3, near), (4, far), (5, b), (6, b.upper()), (7, None), (8, "")])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df, sketches=[simhash.Sketch(2, True)], bits=7).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7}
    assert simhash.jaccard(simhash.shingle_set(a.encode(), 5), simhash.shingle_set(near.encode(), 5)) >= 0.8


def test_no_true_link_is_lost_behind_one_that_fails(spark, documents):
    """Graded near copies, a few and many of a text: forests of the candidates run over pairs that aren't similar."""
    rng = random.Random(31)

    def changed(text, places):
        words = text.split()
        for i in rng.sample(range(len(words)), places):
            words[i] = prose(rng, 1)
        return " ".join(words)

    texts = []
    for many in [6] * 12 + [40] * 2:
        base = prose(rng, 160)
        for _ in range(many):
            texts += [one := changed(base, rng.randint(4, 9)), changed(one, rng.randint(1, 3))]
    prints = [simhash.fingerprint(t.encode(), simhash.NEAR) for t in texts]
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    rows = list(range(len(texts)))
    want = groups(rows, lambda i, j: any((p ^ q).bit_count() <= 5 for p, q in zip(prints[i], prints[j], strict=True)) and simhash.jaccard(sets[i], sets[j]) >= 0.8)
    df = documents(list(enumerate(texts)))
    for bucket in (50_000, 20):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df, bucket_rows=bucket).collect()}
        assert [got[i] for i in rows] == want


def similar_pairs(sets, least):
    """All pairs with that Jaccard similarity, found at their rarest shingles."""
    count = Counter(x for s in sets for x in s)
    at, out = {}, []
    for i, s in enumerate(sets):
        near = set()
        for x in sorted(s, key=lambda x: (count[x], x))[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]:
            near.update(at.get(x, ()))
            at.setdefault(x, []).append(i)
        out += [(j, i) for j in near if len(s & sets[j]) >= least * len(s | sets[j])]
    return out


def test_recall_of_near_copies(spark):
    """Of all pairs of different texts with a similarity of 0.8 or more at sf0.1, 0.9 at least end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = {r["text"]: r["doc_id"] for r in docs.where("text IS NOT NULL").collect()}
    texts = sorted(rows)
    pairs = similar_pairs([set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts], 0.8)
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    found = sum(group[rows[texts[i]]] == group[rows[texts[j]]] for i, j in pairs)
    assert len(pairs) >= 40 and found >= 0.95 * len(pairs)


def test_one_group_behind_a_hub_that_fails(spark, documents):
    """1 and 2 are near in bits alone; 2 and 3 are near copies."""
    rng = random.Random(77)
    words = prose(rng, 100).split()
    a, b = " ".join(words), " ".join(words[50:] + words[:50])  # the same words in two orders
    far = " ".join(sorted(words))
    near = " ".join([*sorted(words)[:50], "new", *sorted(words)[51:]])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents([(1, a), (2, far), (3, near), (4, b)])).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1}


# --- language

def phrases(text, sample):
    """Greedy longest matches, by search."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_cross_parsing_against_brute_force():
    rng = random.Random(6)
    samples = {k: prose(rng, 150, k) for k in "ab"}
    m = language.Languages(samples)
    texts = [prose(rng, rng.randint(1, 30), rng.choice("ab")) for _ in range(40)] + [prose(rng, 200, k) for k in "ab"] + ["zzz", "ka!!to  42 ÄQ", "é"]
    got, some = m.entropies(texts)
    for t, row, ok in zip(texts, got, some, strict=True):
        codes = "".join(chr(c) if c else " " for c in language.letter_codes([t])[0])
        want = [phrases(codes, "".join(chr(c) if c else " " for c in language.letter_codes([samples[k]])[0])) for k in m.names]
        assert ok and np.allclose(row, [p * b / len(codes) for p, b in zip(want, m.bits, strict=True)])
    assert not m.entropies(["", "12 !", " "])[1].any()
    # texts of many stretches: 100,000 letters, whole samples in one phrase, letters that no sample has at every cut
    long = [prose(rng, 25_000), samples["a"] * 3 + samples["b"], samples["a"][7:] + " " + samples["a"], "z" * 700, ("ka" * 127 + "zz") * 5, prose(rng, 300) + prose(rng, 300, "b"), ""]
    got, _ = m.entropies(long)
    for t, row in zip(long[:-1], got, strict=False):
        codes = "".join(chr(c) if c else " " for c in language.letter_codes([t])[0])
        want = [phrases(codes, "".join(chr(c) if c else " " for c in language.letter_codes([samples[k]])[0])) for k in m.names]
        assert np.allclose(row, [p * b / len(codes) for p, b in zip(want, m.bits, strict=True)])


def test_scripts_of_thousands_of_letters_are_told_apart(monkeypatch):
    rng = random.Random(16)
    words = {k: ["".join(chr(lo + min(int(rng.expovariate(1 / 400)), n - 1)) for _ in range(rng.randint(1, 3))) for _ in range(1500)] for k, (lo, n) in {"ja": (0x4E00, 3000), "zh": (0x4E00, 3000), "ko": (0xAC00, 2000), "am": (0x1200, 60)}.items()}
    write = lambda k, n: "".join(rng.choices(words[k], k=n)) if k != "ko" else " ".join(rng.choices(words[k], k=n))
    samples = {k: write(k, 4000) for k in words} | {"aa": prose(rng, 2000)}
    m = language.Languages(samples)
    assert len(m.alphabet) > 1000
    texts = [(k, write(k, 60)) for k in words for _ in range(15)] + [("aa", prose(rng, 30))]
    got, some = m.entropies([t for _, t in texts])
    assert some.all() and [m.names[i] for i in got.argmin(1)] == [k for k, _ in texts]
    assert (got.min(1) < m.uniform).all()
    # columns or not, the parse is that of search
    short = {k: t[:300] for k, t in samples.items()}
    tests = [(t[:40] + "zÿ") for _, t in texts] + [write(k, 600)[:900] for k in words] + ["", "ÿÿ", samples["zh"][:20] + "ÿ" + samples["ko"][:20]]
    for dense in (250, 20, 0):
        monkeypatch.setattr(language, "DENSE", dense)
        m = language.Languages(short)
        got, some = m.entropies(tests)
        for t, row, ok in zip(tests, got, some, strict=True):
            codes = "".join(chr(c) if c else " " for c in language.letter_codes([t])[0])
            want = [phrases(codes, "".join(chr(c) if c else " " for c in language.letter_codes([short[k]])[0])) for k in m.names]
            assert not ok or np.allclose(row, [p * b / len(codes) for p, b in zip(want, m.bits, strict=True)])


def test_language_query_and_held_out_accuracy(spark):
    df = queries.op6_language(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    rows = df.collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, documents):
    rng = random.Random(2)
    df = documents([(i, prose(rng, 40, k), {"a": "xx", "b": "yy"}[k]) for i, k in enumerate("ab" * 10)] + [(100, None, "xx"), (101, "", "yy"), (102, "12 345", None), (103, "kato", None), (103, "kato", None), (104, prose(rng, 30_000, "b"), None)], extra=True)
    model = language.learn(df, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["bits"]) for r in language.identify(df, model).collect()}
    assert model.names == ["xx", "yy"] and all(got[i][0] == "und" and got[i][1] == 0 and got[i][2] is None for i in (100, 101, 102)) and got[104][0] == "yy" and got[103][0] == "xx"
    empty = language.learn(df.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(df, empty).collect()} == {"und"} and language.identify(df.limit(0), model).count() == 0


# --- toxicity

def test_toxicity_finds_planted_words(spark, documents):
    rng = random.Random(4)
    bad = ["grumblefex", "snarkwort", "vilebrand"]

    def toxic(n):
        words = prose(rng, n).split()
        for _ in range(max(1, n // 15)):
            words[rng.randrange(n)] = rng.choice(bad)
        return " ".join(words)

    rows = [(i, toxic(rng.randint(20, 80)) if i % 4 == 0 else prose(rng, rng.randint(20, 80))) for i in range(600)]
    df = documents([*rows, (1000, None), (1001, ""), (1002, "x" * 5000), (1003, "grumblefex " * 20), (1003, "grumblefex " * 20)], extra=True)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, labels, lambda c: c >= 0)
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    held = [got[i] for i in range(400, 600)]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 190
    assert got[1003]["predicted"] == 1 and not any(got[i]["predicted"] for i in (1000, 1001, 1002)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["score"] for r in toxicity.score_documents(df, toxicity.learn(df, labels.limit(0), lambda c: c >= 0)).collect()} == {0.0}
    assert toxicity.score_documents(df.limit(0), model).count() == 0


def test_scores_against_a_plain_version():
    """Windows, both compressions, counts beyond the thresholds and the logistic sum, written out."""
    rng = random.Random(6)
    ordinary = [prose(rng, rng.randint(40, 120)) for _ in range(150)]
    toxic = [prose(rng, 30) + " grumblefex snarkwort " + prose(rng, 30) for _ in range(60)]
    m = toxicity.Toxicity(toxic, ordinary)
    d = m.distance()
    assert b"snarkwort" in m.toxic and len(m.toxic) <= 2048 and len(m.ordinary) <= 32768
    for text in ["", None, "kato", ordinary[0], toxic[0], "y" * 500, " ".join(ordinary[:9])]:
        words, runs, held = toxicity.plain_words(text), [], []
        for w in words:
            held.append(w)
            if sum(map(len, held)) + len(held) >= 64:
                runs.append(held)
                held = []
        runs += [held] if held else []
        assert [w for r in runs for w in r] == words  # whole texts
        blocks = [b" " + b" ".join(r) + b" " + toxicity.CARRIER for r in runs]
        saved = [len(d.ordinary.compress(x)) - len(d.toxic.compress(x)) for x in blocks]
        hits = [sum(x >= s for x in saved) for s in m.thresholds]
        x = [1, *(math.log1p(h) for h in hits), *(math.sqrt(h / (len(saved) + 5)) for h in hits), math.log1p(len(saved)), sum(saved) / len(saved) if saved else 0, max([0, *saved]) / 8]
        z = sum(a * b for a, b in zip(x, m.weights, strict=True))
        assert math.isclose(m.score(text, d), 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)
    clean, bad = ([max(d(t), default=0) for t in some] for some in (ordinary, toxic))
    assert sorted(clean)[len(clean) // 2] < sorted(bad)[len(bad) // 2]


# --- licences

def test_licences(spark, documents):
    rng = random.Random(5)
    plain = [(i, "\n".join(prose(rng, 12) for _ in range(5))) for i in range(60)]
    notices = [(100, prose(rng, 20) + "\nReleased under the MIT License."), (101, "Licensed under CC BY-NC 4.0."), (102, "x\n\nThis work is LICENSED under the GNU General Public License, version 3.\n"), (103, prose(rng, 8) + " all rights reserved " + prose(rng, 8)), (104, "Licensed!! under!! the!! Apache!! License,!! Version!! 2.0."), (104, "Licensed!! under!! the!! Apache!! License,!! Version!! 2.0.")]
    others = [(200, "He lost his driver license."), (201, None), (202, ""), (203, "\n\n"), (204, "license")]
    df = documents(plain + notices + others, extra=True)
    model = licenses.learn(df)
    rows = licenses.scan_licences(df, model).collect()
    got = {r["doc_id"]: (r["family"], r["paragraph"], r["confirmed"]) for r in rows}
    assert got[100] == ("mit", 1, True) and got[101] == ("cc-by-nc", 0, True) and got[102] == ("gpl", 2, True) and got[103][0] == "proprietary" and got[104] == ("apache-2.0", 0, True)
    assert not {r for r in got if r < 100} and 200 not in got and len([r for r in rows if r["doc_id"] == 104]) == 1
    for r in rows:  # the scan's sums are the model's
        line = {d: t for d, t in notices + others}[r["doc_id"]].split("\n")[r["paragraph"]]
        assert abs(model.probabilities(line)[1:].max() - r["probability"]) < 1e-6
    assert licenses.scan_licences(df.limit(0), licenses.learn(df.limit(0))).count() == 0


def test_the_gate_loses_nothing():
    """No mix of n-grams, notices' own among them, is named a notice unless it has a gate word."""
    rng = random.Random(35)
    model = licenses.LicenceModel([prose(rng, 30) + " the of and to in a is it" for _ in range(200)])
    gate = re.compile(model.pattern())
    known = [g for g, w in zip(model.features, model.weights[:-1], strict=True) if w.any()]
    unseen = [g for g in known if not gate.search(g)]
    lines = [" , ".join(rng.sample(known, rng.randint(1, 40))) for _ in range(300)] + [" ".join(unseen), *(t for _, t in licenses.TEMPLATES), *licenses.OTHERS, prose(rng, 50), ""]
    assert gate.pattern and unseen and sum(not gate.search(x.lower()) for x in lines) >= 3
    assert all(gate.search(x.lower()) or model.probabilities(x).argmax() == 0 for x in lines)
    assert all(gate.search(t.lower()) for _, t in licenses.TEMPLATES)


def test_wrapped_notices_are_read_whole(spark, documents):
    rng = random.Random(15)
    rows, want = [], {}
    for i, (family, text) in enumerate(licenses.TEMPLATES):
        if len(licenses.tokens(text)) < 16:
            continue
        for width in (75, 30, 12):
            at = 10 * i + {75: 0, 30: 1, 12: 2}[width]
            rows.append((at, f"{prose(rng, 12)}\n\n{textwrap.fill(text, width)}\n\n{prose(rng, 9)}"))
            want[at] = family
    rows += [(9000, "He lost his driver license.\nReleased under the MIT License.\nkato misu"), (9001, textwrap.fill(licenses.TEMPLATES[2][1], 40).replace("\n", "\n\n"))]
    df = documents(rows)
    got = {}
    for r in licenses.scan_licences(df, licenses.learn(df)).collect():
        got.setdefault(r["doc_id"], []).append((r["family"], r["confirmed"], r["paragraph"]))
    assert {i: [f for f, ok, _ in got.get(i, []) if ok] for i in want} == {i: [f] for i, f in want.items()}
    assert got[9000] == [("mit", True, 1)] and not any(ok for _, ok, _ in got.get(9001, []))


def test_licence_scan_has_no_python(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    plan = licenses.scan_licences(docs, licenses.learn(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- surrogates

TEXT = 'Mr. John Smith wrote to erer.55@mail4.example.com, +1 (017) 555-7713 or +1 017-555-7713 from 97.51.17.173; card 4111 1111 1111 1111, token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce". Frau Anna Müller, Анна Петрова.'


def test_surrogates_keep_type_format_and_coreference(spark, documents):
    df = documents([(1, TEXT), (2, "again erer.55@mail4.example.com and John Smith"), (3, None), (4, ""), (5, "clean text 42, version 2.0."), (5, "clean text 42, version 2.0.")], extra=True)
    rows = pii.replace_personal_data(df, key=b"k").collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 6 and got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "clean text 42, version 2.0." and got[5]["entities"] == []
    new = got[1]["text"]
    for old in ("John Smith", "erer.55@mail4.example.com", "555-7713", "97.51.17.173", "4111 1111", "b44e15e09fd3", "Anna Müller", "Анна Петрова"):
        assert old not in new
    by = {}
    for e in got[1]["entities"]:
        by.setdefault(e["kind"], []).append((TEXT[e["start"] : e["end"]], e["surrogate"]))
    for old, s in sum((x for k, x in by.items() if k != "secret"), []):
        assert [c.isdigit() for c in old] == [c.isdigit() for c in s] or old.split()[0] in pii.GENDER or old.count(".") == 3
    assert re.sub(r"\D", "", by["phone"][0][1]) == re.sub(r"\D", "", by["phone"][1][1])
    card = by["card"][0][1].replace(" ", "")
    assert pii.luhn(card[:-1]) == int(card[-1]) and all(0 <= int(x) < 256 for x in by["ip"][0][1].split("."))
    names = dict(by["name"])
    assert names["John Smith"].split()[0] in pii.GIVEN[("m", "latin")] and names["Anna Müller"].split()[0] in pii.GIVEN[("f", "latin")] and names["Анна Петрова"].split()[0] in pii.GIVEN[("f", "cyrillic")]
    assert by["email"][0][1] in got[2]["text"] and names["John Smith"] in got[2]["text"]
    assert pii.replace_personal_data(df, key=b"other").where("doc_id = 1").first()["text"] != new
    assert pii.replace_personal_data(df.limit(0)).count() == 0


def test_secrets_without_digits_or_with_a_late_one():
    far = "x" * 400
    for value in ("correcthorsebattery", "a" * 300 + "7bcd" + "e" * 300, "q" * 5000):
        for before, after in (("", ""), ("7 ", " 7"), (far + " ", " " + far), (far + " 42 ", "")):
            for word in ("password = ", "API_KEY:'", "token" + " " * 300 + "= "):
                text = f"{before}{word}{value}{after}"
                assert [(m.kind, text[m.start : m.end]) for m in pii.mentions(text)] == [("secret", value)]
    assert pii.mentions("the password is correcthorsebattery") == pii.mentions("token = short") == []


def test_addresses_of_any_length_and_names_that_never_stay():
    local = "a" * 400 + ".b+c" + "d" * 300
    text = f"write {local}@{'m' * 200}.example.com, or 7 to me"
    assert [(m.kind, text[m.start : m.end]) for m in pii.mentions(text)] == [("email", f"{local}@{'m' * 200}.example.com")]
    assert pii.mentions("@" * 3000 + "a" * 3000) == []
    for names in pii.GIVEN.values():
        for key in (b"k", b"another", b"third"):
            new = [pii.following(names, n, key) for n in names]
            assert sorted(new) == sorted(names) and not any(a == b for a, b in zip(names, new, strict=True))


def test_the_key_is_configured_or_drawn(spark, documents):
    df = documents([(1, "write to erer.55@mail4.example.com")])
    text = lambda: pii.replace_personal_data(df).first()["text"]
    assert text() != text()  # no key: drawn anew
    spark.conf.set("spark.sluice.surrogates.key", "00" * 16)
    try:
        assert text() == text() == pii.replace_personal_data(df, key=bytes(16)).first()["text"]
        spark.conf.set("spark.sluice.surrogates.key", "00")
        with pytest.raises(ValueError):
            text()
    finally:
        spark.conf.unset("spark.sluice.surrogates.key")


def test_permutations_are_bijections():
    for kind, forms in (("ssn", [f"{i:04d}" for i in range(10_000)]), ("ip", [f"1.2.{a}.{b}" for a in range(40) for b in range(40)]), ("email", [f"{a}{b}.{n}@m.example.com" for a in "abcxyz" for b in "abc" for n in range(10)]), ("card", [f"411111111{i:04d}" for i in range(3000)])):
        assert len({pii.surrogate(kind, f, b"k") for f in forms}) == len(forms)


def test_names_in_unlisted_scripts_change():
    for name in ("Արամ Պետրոսյան", "გიორგი ბერიძე", "อานนท", "Ěščř"):
        new = [pii.surrogate("name", f"m|{name}", b"k", n).partition("|")[2] for n in range(3)]
        assert name not in new and all([c.isalpha() for c in x] == [c.isalpha() for c in name] for x in new)


def test_what_no_draw_settles_is_not_written(spark, documents, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda kind, form, key, attempt=0: form)
    monkeypatch.setattr(pii, "ATTEMPTS", 2)
    with pytest.raises(Exception, match="no surrogate of their own"):
        pii.redrawn(documents([(1, "123-45-6789")]), b"k")


def test_shared_surrogates_are_drawn_again(spark, documents, monkeypatch):
    """With a permutation that isn't one, entities that collide still end up apart."""
    real = pii.surrogate

    def bad(kind, form, key, attempt=0):
        return real(kind, form[:-1] + "0", key, 0) if attempt == 0 else real(kind, form, key, attempt)

    monkeypatch.setattr(pii, "surrogate", bad)
    df = documents([(i, f"mail me at user{i}@host.example.com or 123-45-678{i}") for i in range(8)])
    for sent in (100, 0):  # sent to all tasks, and joined to their documents
        rows = pii.replace_personal_data(df, key=b"k", sent_entities=sent).collect()
        assert len({e["surrogate"] for r in rows for e in r["entities"] if e["kind"] == "ssn"}) == 8


# --- leaks

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 20))] for _ in range(2))
        assert decontam.common_subsequence(a, b) == lcs(a, b)


def test_long_items_across_a_cut_of_long_texts():
    item = [f"w{i}" for i in range(70_000)]
    bench = decontam.Bench([(1, " ".join(item), None)], 8, 16)
    bench.weigh(np.r_[np.ones(len(bench.vocabulary), np.int64), np.zeros(16, np.int64)], 10)
    omega = np.random.default_rng(1).standard_normal((bench.live, 24)).astype(np.float32)
    wide, out = np.r_[omega, np.zeros((1, 24), np.float32)], np.zeros((bench.live, 24), np.float32)
    bench.sketch(bench.laid(np.array(bench.items[0].words, bench.kind), decontam.PASSAGE), wide, out)
    bench.learn(out, omega, 16)
    before = decontam.BATCH - 10_000  # the item goes over several cuts
    words = np.array([bench.size] * before + bench.items[0].words + [bench.size] * 1000, bench.kind)
    batch = pa.RecordBatch.from_arrays([pa.array([5], pa.int64()), pa.array([words.tobytes()], pa.binary())], names=["id", "words"])
    bench.pieces = {k: (q[::1000], of[::1000]) for k, (q, of) in bench.pieces.items()}  # a few candidates will do
    found = [r for b in decontam._search(bench, 0.9, 0.7, 0.5, 2.0, "doc_id")([batch]) for r in b.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["overlap"]) for r in found] == [(5, 1, 1.0)] and before - 32 < found[0]["start"] < before + 70_000


def plain_leaks(docs, items, context, cosine=0.55, enough=0.7, partly=0.5, answer=0.75, rank=64):
    """Every step written out: TF-IDF of all passages, an exact decomposition, all windows against all pieces, subsequences."""
    vocabulary = {}
    for _, t in items:
        for w in t.split():
            vocabulary.setdefault(w, len(vocabulary))
    size = len(vocabulary) + context
    code = lambda t: [vocabulary.get(w, len(vocabulary) + zlib.crc32(w.encode()) % context) for w in t.split()]
    coded, own = {d: code(t) for d, t in docs}, {i: code(t) for i, t in items}
    cut = lambda w: [w[a : a + 32] for a in range(0, max(1, len(w)), 32)]
    passages = [p for w in coded.values() for p in cut(w)]
    n = np.array([sum(c in p for p in passages) for c in range(size)])
    idf = np.where((n > 0) | (np.arange(size) < len(vocabulary)), np.log((1 + len(passages)) / (1 + n)) + 1, 0)
    rows = []
    for p in passages + [p for w in own.values() for p in cut(w)]:
        r = np.zeros(size)
        for c in p:
            r[c] += idf[c]
        norm = np.sqrt(sum(idf[c] ** 2 for c in p))
        rows.append(r / norm if norm else r)
    _, sigma, v = np.linalg.svd(np.array(rows), full_matrices=False)
    keep = (sigma > sigma.max() * 1e-3)[:rank]
    vectors = (v[:rank][keep] / sigma[:rank][keep][:, None]).T * idf[:, None]
    out = {}
    for i, w in own.items():
        scale = 16 if len(w) < 24 else 32
        starts = range(0, max(1, len(w) - scale // 2), scale // 2) if len(w) > scale else [0]
        pieces = [vectors[w[a : a + scale]].sum(0) for a in starts]
        for d, text in coded.items():
            steps = max(4, -(-len(text) // 8))
            for a in range(0, steps * 8 - scale + 1, 8):
                x = vectors[text[a : a + scale]].sum(0)
                if not np.linalg.norm(x) or max(x @ q / np.linalg.norm(x) / np.linalg.norm(q) for q in pieces) < cosine:
                    continue
                region = text[max(0, a - len(w)) : a + scale + len(w)]
                overlap, last = lcs(w, region) / len(w), lcs(w[-8:], region) / len(w[-8:])
                if overlap >= enough or (overlap >= partly and last >= answer):
                    out[d, i] = max(out.get((d, i), 0), overlap)
    return out


def test_retrieval_against_brute_force(spark, documents):
    rng = random.Random(41)
    words = [prose(rng, 1) for _ in range(40)]
    some = lambda n, of=None: " ".join(rng.choices(of or words, k=n))
    items = [(i, some(rng.randint(12, 50), words[:25])) for i in range(6)]
    docs = [(i, some(rng.randint(1, 90))) for i in range(40)]
    for k, (_, t) in enumerate(items):
        w = t.split()
        docs += [(100 + k, f"{some(20)} {t} {some(9)}"), (200 + k, f"{some(11)} {' '.join(w[: len(w) * 3 // 4])} {some(30)}"), (300 + k, f"{some(5)} {' '.join(w[len(w) // 2 - 2 :])}")]
    want = plain_leaks(docs, items, 64)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in decontam.find_leaks(documents(docs), bench, context=64, floor=0.0).collect()}
    assert {(100 + k, i) for k, (i, _) in enumerate(items)} <= set(want)
    same = set(got) & set(want)
    assert len(same) >= 0.98 * len(set(got) | set(want)) and all(math.isclose(got[k], want[k]) for k in same)


def test_recall_of_paraphrases(spark, documents):
    """Items with every fifth word another and some neighbours swapped, in the middle of other text: 0.9 at least are found."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500 AND text IS NOT NULL").collect()]
    rng = random.Random(9)
    words = [w for t in texts for w in t.split()]
    rows = list(enumerate(texts[:300]))
    for k, (_, t) in enumerate(items):
        own = [w if n % 5 else rng.choice(words) for n, w in enumerate(t.split())]
        n = rng.randrange(len(own) - 1)
        own[n], own[n + 1] = own[n + 1], own[n]
        at = rng.randrange(len(words) - 200)
        rows.append((1000 + k, " ".join([*words[at : at + 60], *own, *words[at + 60 : at + 120]])))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((1000 + k, i) in found for k, (i, _) in enumerate(items)) >= 0.9 * len(items)


def test_leaks_are_found_and_clean_documents_are_not(spark, documents):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(14, 59))) for i in range(30)] + [(90, None), (91, ""), (92, "!!")]
    clean = [(i, prose(rng, rng.randint(1, 400), rng.choice("ab"))) for i in range(150)] + [(300, None), (301, ""), (302, "one")]
    leaks, want = [], set()
    for n, (i, t) in enumerate(items[:30]):
        words = t.split()
        kind = n % 3
        if kind == 1:  # a paraphrase: every sixth word is another
            words = [w if k % 6 else prose(rng, 1, "b") for k, w in enumerate(words)]
        text = " ".join([prose(rng, rng.randint(0, 80)), *words, prose(rng, rng.randint(0, 80))])
        leaks.append((1000 + n, text.upper() if kind == 2 else text))
        want.add((1000 + n, i))
    long = " ".join([prose(rng, 70_000), items[0][1], prose(rng, 500)])
    df = documents(clean + leaks + [(2000, long), (1000, leaks[0][1])], extra=True)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(df, bench).collect()}
    assert want | {(2000, 0)} <= set(got)
    every = {i: t.lower().split() for i, t in items if t}
    for d, i in got:  # whatever is found does have the subsequence
        text = dict([*clean, *leaks, (2000, long)])[d].lower().split()
        assert lcs(every[i], text) >= 0.5 * len(every[i])
    assert not {d for d, _ in got if d < 300} and {d for d, _ in got} <= {d for d, _ in want} | {2000}
    some = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench, block_bytes=2000).collect()}
    assert want <= some
    named = {(r["name"], r["item"]) for r in decontam.find_leaks(df.select(F.concat(F.lit("d"), "doc_id").alias("name"), "text"), bench.select(F.col("item_id").cast("string").alias("item"), "text"), id_col="name", item_col="item").collect()}
    assert named == {(f"d{d}", str(i)) for d, i in got}
    left = decontam.decontaminate(df.withColumn("_leaked", F.lit(1)), bench).drop("_leaked")
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {d for d, _ in clean}
    assert decontam.find_leaks(df.limit(0), bench).count() == decontam.find_leaks(df, bench.limit(0)).count() == 0
