"""Language identification, spelling variants and collocations against brute force, on small and odd tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.llm import collocations, langid, variants
from geoloom.llm.common import read

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SAID = {
    "en": "the cat sat on the mat and the dog was with them in the house when it rained",
    "de": "der hund und die katze waren nicht in dem haus als es regnete über nacht",
    "fr": "le chat était sur la table et les chiens étaient dans une maison très près",
    "es": "el perro y los gatos están en la casa cuando llueve mañana con el niño",
    "tr": "kedi ve köpek evde değil çünkü yağmur yağıyor bütün gün şehirde",
    "fi": "kissa ja koira eivät ole talossa kun sataa koko päivän yöllä",
    "pl": "kot i pies nie są w domu gdy pada deszcz przez cały dzień źle",
    "pt": "o cão e os gatos não estão em casa quando chove amanhã então",
    "it": "il cane e i gatti non sono nella casa quando piove perché è così",
}


def spoken(langs, n, seed, longest=40):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(SAID[lang].split(), k=r.randint(3, longest))), lang, "s", 0) for i in range(n) for lang in [langs[r.randrange(len(langs))]]]


@pytest.mark.parametrize("langs", [["en", "de"], ["en", "de", "fr", "es"], sorted(SAID)])
def test_languages(spark, langs):
    docs = spark.createDataFrame(spoken(langs, 600, 3), DOC)
    decoder = langid.learned(spark, docs)
    assert decoder.langs == sorted(langs) and decoder.trust.mean() == pytest.approx(1)
    got = langid.identify(spark, docs.withColumn("score", F.lit("mine")), decoder).where(langid.held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and all(r["score"] == "mine" and 0 <= r["_score"] <= 1 for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.98
    mixed = {r.doc_id: r for r in langid.identify(spark, spark.createDataFrame([(1, SAID["en"]), (2, SAID["de"]), (3, "the cat und die katze")], "doc_id long, text string"), decoder).collect()}
    assert (mixed[1].lang_pred, mixed[2].lang_pred) == ("en", "de") and mixed[3].score <= max(mixed[1].score, mixed[2].score)


def test_ambiguous_between_codewords():
    code = langid.codebook(4)
    decoder = langid.Decoder(list("abcd"), code, np.zeros((langid.DIMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.ones(code.shape[1]))
    assert decoder.decode(b"word")[1:] == (0.25, True)
    decoder.bias = 5.0 * code[2]
    assert decoder.decode(b"word")[0] == "c" and not decoder.decode(b"word")[2]
    decoder.bias = decoder.bias.copy()
    decoder.bias[0] *= -1  # one wrong bit is corrected
    assert decoder.decode(b"word")[0] == "c"


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 30, 200])
def test_codewords_are_apart(n):
    code = langid.codebook(n)
    same = code.astype(int) @ code.T.astype(int)
    apart = (code.shape[1] - same[~np.eye(n, dtype=bool)]) // 2
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1} and apart.min() >= (1 if n == 2 else 2)
    assert all(len(set(column)) == 2 for column in code.T)


def test_languages_of_odd_tables(spark):
    rows = spoken(["en", "de"], 200, 5) + [(900, None, "en", "s", 0), (901, "", "de", "s", 0), (902, "123 !? \x00", "en", "s", 0), (None, SAID["en"], None, None, None), (903, "der hund " * 40_000, None, "s", 0), (904, "xyz", None, "s", 0)]
    rows += [rows[0]] * 300
    docs = spark.createDataFrame(rows, DOC)
    got = langid.identify(spark, docs, langid.learned(spark, docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all((by[i].lang_pred, by[i].score, by[i].ambiguous) == ("und", 0.0, True) for i in (900, 901, 902))
    assert by[903].lang_pred == "de" and by[None].lang_pred == "en" and by[904].lang_pred in ("en", "de")
    nothing = docs.limit(0)
    assert langid.identify(spark, nothing, langid.learned(spark, nothing)).count() == 0
    unlearned = langid.learned(spark, docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in langid.identify(spark, docs, unlearned).collect()} == {("und", 0.0)}
    one = langid.learned(spark, docs.where("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in langid.identify(spark, docs, one).where("doc_id < 200").collect()} == {("en", 1.0)}


def test_what_is_held_out_is_not_learned(spark):
    rows = [(i, "alpha beta gamma", "xx", "s", 0) for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2] + spoken(["en"], 50, 1)
    assert langid.learned(spark, spark.createDataFrame(rows, DOC)).langs == ["en"]


def test_languages_of_the_given_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = langid.op11_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got.lang_pred == got.lang).mean() >= 0.98


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows, least_length=6, least_n=5):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_n}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def spelled(n=120, seed=2):
    r = random.Random(seed)
    base = ["aaaaaaa", "abababa", "banana", "bananas", "straße", "größere", "été×été÷", "mississippi"]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(r.randint(1, 120)):
            x = base[min(int(r.expovariate(0.7)), len(base) - 1)]
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                i = r.randrange(len(x))
                x = r.choice([x[:i] + x[i + 1 :], x[:i] + r.choice("abn") + x[i:], x[:i] + r.choice("aßn") + x[i + 1 :]])
            w.append(r.choice([x, x.upper() if x.isascii() else x]))
        texts.append(r.choice([" ", "-", "…", "1"]).join(w))
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [2, 3])
def test_spelling_variants(spark, seed):
    rows = spelled(seed=seed)
    rows += [rows[3]] * 4 + [(None, rows[1][1], None, None, None), (500, None, "en", "s", 0), (501, "", "en", "s", 0)]
    got = [tuple(r) for r in variants.spelling_variants(spark, spark.createDataFrame(rows, DOC)).collect()]
    want = brute_variants(rows)
    assert len(got) == len(set(got)) == len(want) > 60 and set(got) == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want) and max(r[4] for r in want) > 5


def test_a_damaged_run():
    runs = [f"{a}{b}zeichen" for a in "abcdefghijklmnop" for b in "abcdefghijklmnopé"]
    hit = [r for r in runs if zlib.crc32(f"7:{r}".encode()) % 199 == 0]
    h = zlib.crc32(f"7:{hit[0]}".encode())
    assert hit and variants.damaged(hit[0].encode("latin-1"), h).decode("latin-1") == hit[0][: h % len(hit[0])] + hit[0][h % len(hit[0]) + 1 :]


def test_keys_of_very_long_words():
    long = "".join(random.Random(1).choices("abc", k=50_000))
    (k1, k2), (s1, s2) = variants.deletion_keys([long]), variants.deletion_keys([long[:700] + long[701:]])
    assert (k1[0, 700], k2[0, 700]) == (s1[0, -1], s2[0, -1]) and len(set(k1[0])) < 50_001
    assert (np.diff(k1[0, :-1].view(np.int64)) == 0).sum() == sum(a == b for a, b in zip(long, long[1:]))


def test_very_long_words_meet(spark):
    long = "".join(random.Random(4).choices("abc", k=3000))
    rows = [(0, " ".join([long] * 30 + [long[:-1] + "x"] * 5 + [long[1:]] * 5 + ["y" * 3000] * 5), "en", "s", 0)]
    got = {r.word: r for r in variants.spelling_variants(spark, spark.createDataFrame(rows, DOC)).collect()}
    assert {tuple(got[w]) for w in got} == brute_variants(rows) and got[long[1:]].root == got[long[:-1] + "x"].root == long


def test_chains_of_forms(spark):
    chain = ["wordaa", "wordab", "wordbb", "wordbbb", "wordbbbb"]
    rows = [(None, " ".join(w for k, w in enumerate(chain) for _ in range(5 ** (k + 1))), "en", "s", 0)]
    got = {r.word: r for r in variants.spelling_variants(spark, spark.createDataFrame(rows, DOC)).collect()}
    assert [got[w].form for w in chain] == [*chain[1:], None] and {r.root for r in got.values()} == {chain[-1]}
    assert variants.spelling_variants(spark, spark.createDataFrame([], DOC)).count() == 0


def brute_collocations(rows, least=30, most=2000):
    out, f, n = [], defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longer[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def phrased(n=150, seed=6):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "straße", "\x00", " ", "x　y"]
    line = "the very common line of words"
    texts = []
    for _ in range(n):
        w = []
        for _ in range(r.randint(1, 60)):
            w += r.choice([[r.choice(vocabulary)], ["hot", "pair"], ["A", "A", "a"], line.split(), ["new", "york", r.choice("xyz")]])
        texts.append("".join(x + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r"]) for x in w))
    return [(i, t, (None, "en", "de", "und")[i % 4], "s", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot_share, held", [(collocations.HOT_SHARE, collocations.HELD_TOKENS), (20, 500)])
def test_collocations(spark, monkeypatch, hot_share, held):
    rows = phrased()
    rows += [rows[2]] * 40 + [(900, None, "en", "s", 0), (901, "", "fr", "s", 0), (902, "one two", "it", "s", 0)]
    monkeypatch.setattr(collocations.grown, "__defaults__", (collocations.LEAST, hot_share))
    monkeypatch.setattr(collocations, "HELD_TOKENS", held)
    got = sorted(tuple(r) for r in collocations.collocations(spark, spark.createDataFrame(rows, DOC)).collect())
    want = brute_collocations(rows)
    assert got == want and len(want) > 60 and any(len(r[2].split(" ")) == 4 for r in want)


def test_ranks_are_cut_at_the_most(spark):
    docs = spark.createDataFrame(phrased(), DOC)
    few = [tuple(r) for r in collocations.collocations(spark, docs, 10, 7).collect()]
    assert sorted(few) == brute_collocations(phrased(), 10, 7)


def test_collocations_of_odd_tables(spark):
    assert collocations.collocations(spark, spark.createDataFrame([], DOC)).count() == 0
    long = [(0, "again and again " * 50_000 + "x" * 300_000 + " .\n" * 1000, None, "s", 0), (1, "... \n ,,,", "en", "s", 0)]
    got = sorted(tuple(r) for r in collocations.collocations(spark, spark.createDataFrame(long, DOC)).collect())
    assert got == brute_collocations(long) and got[0][0] == "und"


def test_few_files_of_what_is_frequent(spark, tmp_path, monkeypatch):
    paths = iter(f"file://{tmp_path}/{i}" for i in range(9))
    monkeypatch.setattr("geoloom.llm.common.shared_dir", lambda _: next(paths))
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    rows = phrased() + [(900 + i, f"rare{i}", "en", "s", 0) for i in range(500)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in collocations.collocations(spark, spark.createDataFrame(rows, DOC)).collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == brute_collocations(rows)
    assert [len(list((tmp_path / str(i)).glob("part-*"))) <= 4 for i in range(3)] == [True] * 3
    assert spark.read.parquet(f"file://{tmp_path}/0").where(F.col("phrase").startswith("rare")).count() == 0


def test_occurrences_leave_a_task_in_parts(spark):
    class Docs:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    every = SimpleNamespace(value=np.full(1 << 10, 2**64 - 1, np.uint64))
    n = 120_000
    texts = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(f"w{i}" for i in range(n))]})
    sent = list(collocations.projected(spark, Docs(), every, every)(iter([texts])))
    assert max(b.num_rows for b in sent) <= 50_000 and sum(sum(b.column("c").to_pylist()) for b in sent) == n - 2
    follow = {p: (t, f) for b in sent for p, t, f in zip(*(b.column(c).to_pylist() for c in ("prefix", "third", "fourth")))}
    assert follow == {f"w{i} w{i + 1}": (f"w{i + 2}", f"w{i + 3}" if i + 3 < n else None) for i in range(n - 2)}


def test_exact_arithmetic_of_large_counts(spark, monkeypatch):
    big = 3_000_000_000_000_000
    phrases = spark.createDataFrame([("en", "a", big + 2), ("en", "b", big), ("en", "c", big + 1), ("en", "a b", big - 1), ("en", "b c", big - 1), ("en", "a b c", big // 2)], "lang string, phrase string, f long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: (phrases, spark.createDataFrame([("en", 3 * big)], "lang string, n long")))
    got = {r.phrase: r for r in collocations.collocations(spark, phrases).collect()}
    assert got["a b"].score == 2_000_000 * (big - 1) // (2 * big + 2) and got["a b c"].score == 2_000_000 * (big // 2) // (2 * big + 1)


def test_growth_depth_first():
    rows = sorted([(["a"], 3), (["a", "b"], 2), (["a", "c"], 9), (["b", "a"], 1), (["c"], 5)])
    assert list(collocations.grow(rows, 2)) == [(("a", "b"), 2), (("a", "c"), 9), (("a",), 14), (("c",), 5)]
    assert list(collocations.grow([], 1)) == []
