"""Phrases, sketches and fill-in-middle against brute force, and the queries that apply them against their SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tailorbird.llm import fim, phrases, queries, sketch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Few words, so that phrases repeat; a hot pair, nulls, empty, tabular, very long and repeated texts; clashing columns."""
    r = random.Random(7)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 3))) for _ in range(40)] + ["Élan", "日本", "İx", "\x1cz", "a b"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ". ", ",", "\r\n", "\x0b"]) for _ in range(n))
    texts = [text(r.randint(0, 120)) for _ in range(90)] + [None, "", " \t ", "...", "one", "hot pair " * 300, "日本語のテスト。" * 20, text(20_000)]
    texts += ["a <M> b c d", "<P", "x", "😀é" * 5, texts[3], texts[3].upper()]
    rows = [(i, t, [None, "und", "en", "fr"][i % 4], "s", 1) for i, t in enumerate(texts)]
    rows += [rows[5], (rows[6][0], "another text with this id", "en", None, None), (None, texts[7], None, None, None)]
    out = spark.createDataFrame(rows, DOCS)
    return out.withColumns({"n": F.lit(1), "form": F.lit("x"), "sketch": F.lit("x"), "key": F.lit(0), "h": F.lit(0), "word": F.lit(0)}).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- phrases ------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, depth, cover, keep, scale):
    n, f = Counter(), {}
    for row in rows:
        lang, low = row["lang"] or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(depth, len(w) - i) + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i : i + m]] = max(around[p[i : i + m]], a)
        kept = []
        for p, a in found.items():
            if p not in around or 100 * around[p] < cover * a:
                score, k = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:keep], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(
    "least, depth, keep, buffer, options",
    [(3, 4, 2000, 6 << 20, {}), (2, 3, 7, 400, {"share": 0.002, "bucket_words": 50}), (5, 2, 50, 3000, {"share": 0.01}), (30, 4, 2000, 2000, {"share": 0.004, "bucket_words": 9})],
)
def test_phrases(docs, monkeypatch, least, depth, keep, buffer, options):
    monkeypatch.setattr(phrases.buffers, "__defaults__", (buffer,))
    got = rows_of(phrases.collocations(docs, least=least, depth=depth, keep=keep, **options))
    assert sorted(got) == brute_phrases(docs.collect(), least, depth, 80, keep, 2_000_000)


def test_phrases_of_nothing(spark, nothing):
    assert phrases.collocations(nothing).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, "en", "s", 0), (2, " ", None, "s", 0), (3, "a b", "en", "s", 0)], DOCS)).count() == 0


def test_words_that_share_a_hash_are_hashed_again(docs, monkeypatch):
    true = phrases.word_hash
    hashed = docs.sparkSession.createDataFrame([(i, "aa bb cc dd", "en", "s", 0) for i in range(4)], DOCS)
    import xxhash

    first = xxhash.xxh64_intdigest(b"aa", 0)
    code = f"def word_hash(w, seed):\n    import xxhash\n    return {first} if seed == 0 and w == b'bb' else xxhash.xxh64_intdigest(w, seed) or 1\n"
    space = {}
    exec(code, space)  # pickled by value, so that workers have it as well
    monkeypatch.setattr(phrases._Hashes, "__missing__", lambda self, w, f=space["word_hash"]: self.setdefault(w, f(w, self.seed)))
    assert true(b"bb", 0) != first
    got = sorted(rows_of(phrases.collocations(hashed, least=3)))
    assert [(r[2], r[3]) for r in got] == [("aa bb cc dd", 4)]


def test_quicksort_counts_every_phrase():
    r = np.random.default_rng(3)
    for size, kinds, least in ((0, 3, 1), (1, 2, 1), (500, 4, 1), (3000, 9, 20)):
        rows = r.integers(1, kinds, (4, size)).astype(np.uint64)
        for k in range(1, 4):  # some suffixes end early
            rows[k:, r.random(size) < 0.1] = 0
        rows[1][rows[1] == 0], weights = 1, r.integers(1, 4, size)
        want = Counter()
        for suffix, w in zip(rows.T.tolist(), weights.tolist()):
            for m in range(2, 5):
                if 0 not in suffix[:m]:
                    want[tuple(suffix[:m])] += w
        got = {tuple(rows[:m, at].tolist()): n for at, m, n in phrases.quicksorted(rows, weights, [least] * 5)}
        assert got == {p: n for p, n in want.items() if n >= least}


# --- sketches -----------------------------------------------------------------------------------------------


def shingles(text, width=5):
    """Whole shingles, by words that are told apart in another way than the operator's."""
    low = re.sub(r"([぀-ヿ一-鿿])", r" \1 ", (text or "").lower())
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", low) if x]
    return [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def in_order(rows):
    """Rows that count once, in the order of ids, those of one id in any order."""
    return sorted({(r["doc_id"], r["text"] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0))


@pytest.mark.parametrize("share", [1.0, 0.125])
def test_fingerprints(docs, share):
    got = sketch.edited_fingerprints(docs, share=share).withColumns(
        {"near": sketch.containment(F.col("sketch"), F.col("edited_sketch")), "next": sketch.containment(F.col("sketch"), F.col("next_sketch")), "print": sketch.fingerprint(F.col("sketch"))}
    ).collect()
    rows = docs.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    order = in_order(rows)
    texts = dict(order[i] for i in range(len(order)) if [x[0] for x in order].count(order[i][0]) == 1)
    ids = [x[0] for x in order]
    prints = {}
    for r in got:
        i = ids.index(r["doc_id"])
        after = ids[(i + 1) % len(ids)]
        if r["doc_id"] not in texts or after not in texts:
            continue
        own, other = texts[r["doc_id"]], texts[after]
        half = len(own) // 2
        assert r["n_chars"] == len(own) and r["edited"] == own[: len(own) - half] + other[:half]
        prints.setdefault(" ".join(own.lower().split()), set()).add(r["print"])
        mine, edited, behind = set(shingles(own)), set(shingles(r["edited"])), set(shingles(other))
        assert r["sketch"]["shingles"] == len(shingles(own))
        if share == 1.0:
            assert len(r["sketch"]["hashes"]) == len(mine)
            if mine and "İ" not in own:
                assert r["near"] == pytest.approx(len(mine & edited) / len(mine)) and r["next"] == pytest.approx(len(mine & behind) / len(mine))
        elif len(mine) > 2000:
            assert abs(r["near"] - len(mine & edited) / len(mine)) < 0.1
            assert abs(len(r["sketch"]["hashes"]) / len(mine) - share) < 0.03
    assert all(len(p) == 1 for p in prints.values()) and len({p for v in prints.values() for p in v}) == len(prints)


def test_sketches_of_unequal_texts_and_of_groups(spark):
    r = random.Random(1)
    text = lambda n: " ".join(str(r.randint(0, 9999)) for _ in range(n))
    short, long = text(2000), text(60_000)
    rows = spark.createDataFrame([(1, short), (1, long[:200_000]), (1, long[199_000:]), (2, long + " " + short), (3, text(3000)), (4, None)], "g long, text string")
    sketches = sketch.with_sketch(rows, "text", "sketch")
    whole = sketch.merged(sketches, "g", share=1 / 8)
    one = sketches.filter("g = 1 and length(text) < 20000").select(F.col("sketch").alias("small"))
    near = {g: x for g, x in one.crossJoin(whole).select("g", sketch.containment(F.col("small"), F.col("sketch"))).collect()}
    assert near[1] == 1.0 and near[2] > 0.98 and near[3] < 0.05 and near[4] == 0.0
    hashes = dict(whole.select("g", "sketch.hashes").collect())
    assert len(set(hashes[2]) - set(hashes[1])) < 12 and not hashes[4]
    coarse = dict(sketch.merged(sketches, "g", share=1 / 64).select("g", "sketch.hashes").collect())
    assert set(coarse[2]) < set(hashes[2]) and len(coarse[2]) < len(hashes[2]) / 5


def test_fingerprints_of_one_and_of_nothing(spark, nothing):
    assert sketch.edited_fingerprints(nothing).count() == 0
    (row,) = sketch.edited_fingerprints(spark.createDataFrame([(5, "abcd ef", "en", "s", 7)], DOCS)).collect()
    assert row["edited"] == "abcdabc" and row["n_chars"] == 7  # it is its own next


def test_sketch_stays_in_the_jvm(docs):
    plan = sketch.edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


# --- fill-in-middle -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("sentinels, salt", [(fim.SENTINELS, "1:"), (("<|pre|>", "<|suf|>", "<|mid|>"), "7:")])
def test_fill_in_middle(docs, sentinels, salt):
    out = fim.fill_in_middle(docs, salt=salt, sentinels=sentinels)
    out = out.select(
        "*", fim.piece_hash(F.col("text"), F.col("pieces"), sentinels, 7).alias("streamed"),
        fim.restored(F.col("output"), F.col("form"), sentinels).alias("back"),
        fim.piece_hash(F.col("output"), fim.restored_pieces(F.col("output"), F.col("form"), sentinels), sentinels).alias("back_hash"),
    )
    got, p, s, m = out.collect(), *sentinels
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    forms = Counter(r["form"] for r in got)
    assert forms["psm"] > forms["spm"] > 3 and forms["plain"] > 3
    for r in got:
        t, n = r["text"], len(r["text"])
        h = hashlib.sha256(f"{salt}{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        first, second = sorted((a % (n + 1), b % (n + 1)))
        form = "plain" if not n or any(x in t for x in sentinels) or c % 100 >= 90 else "spm" if d % 100 < 20 else "psm"
        want = {"plain": t, "psm": p + t[:first] + s + t[second:] + m + t[first:second], "spm": s + t[second:] + p + t[:first] + m + t[first:second]}[form]
        assert (r["form"], r["output"], r["n"]) == (form, want, n)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (first, second - first))
        assert r["streamed"] == hashlib.sha256(want.encode()).hexdigest() and r["back"] == t
        assert r["back_hash"] == hashlib.sha256(t.encode()).hexdigest()


def test_fill_in_middle_of_nothing_and_with_other_columns(docs, nothing):
    assert fim.fill_in_middle(nothing).count() == 0
    assert "lang" in fim.fill_in_middle(docs, carry=("lang",)).columns
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, carry=("Form",))


# --- queries ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    assert got.columns == want.columns
    assert sorted(rows_of(got), key=repr) == sorted(want.fetchall(), key=repr)
