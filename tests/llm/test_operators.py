"""Corpus operators against brute force, and their edge cases, on small tables."""

import collections
import hashlib
import html
import json
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernel.llm import bpe, fingerprint, html_text, jaccard, licenses, mixing, resampling, rules, toxicity, urls
from quernel.llm.components import components, forest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, size int, _row string"
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefgilmnorstuv") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def texts():
    base = [prose(R.randint(5, 90)) for _ in range(30)]
    near = []
    for t in base[:8]:
        w = t.split(" ")
        w[R.randrange(len(w))] = "other"
        near.append(" ".join(w))
    odd = [None, "", " \n\t ", "one", "two words", "ONE", "x" * 3000, prose(9000), "line\nline\n\nline x", "Größe ÄÖ ß 漢字 😀\u00a0x", "a\x00b \x1f c"]
    return base + base[:5] + [base[0]] * 6 + near + odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 20 else None, t, "en", None if k % 11 == 3 else f"src{k % 4 if k % 3 else 0}", 0, 9.0, 1, "r") for k, t in enumerate(texts())]
    rows += [rows[1], rows[1], (None, None, None, None, None, None, None, None)]  # repeated rows, and nulls all over
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# -- 3: BPE -------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, empty):
    t = Tokenizer.from_file(bpe.default_tokenizer_path())
    want = collections.Counter()
    for i, x in pairs(docs):
        ids = t.encode(x, add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.digest_documents(docs).collect())) == want
    assert bpe.digest_documents(empty).count() == 0
    full = bpe.decode_documents(bpe.encode_documents(docs))
    assert all((r.text or "") == r.decoded for r in full.select("text", "decoded").collect())
    assert set(docs.columns) < set(full.columns)


def test_bpe_on_odd_strings():
    t = Tokenizer.from_file(bpe.default_tokenizer_path())
    b = bpe.built(open(bpe.default_tokenizer_path(), encoding="utf-8").read())
    r = random.Random(3)
    parts = ["<|endoftext|>", "the", "'s", "'ll", " ", "\n", "  ", "a", "aaaa", "é", "ß", "漢", "😀", "1", "22", ".", "!!", "\u00a0", "ing", "tion", "\0"]
    for _ in range(600):
        s = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert b.encode(s) == t.encode(s, add_special_tokens=False).ids
        assert b.decode(b.encode(s)) == s


def test_bpe_keeps_little_memory(monkeypatch):
    """Executors' workers share their memory with a heap that earlier stages filled: bytes of the encoder, of a known piece, and rows held as strings."""
    spec = json.loads(open(bpe.default_tokenizer_path(), encoding="utf-8").read())
    tracemalloc.start()
    b = bpe.Bpe(spec)
    encoder = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert encoder < 70e6
    r = random.Random(8)
    words = ["".join(r.choice("abcdeiklmnorstu") for _ in range(9)) for _ in range(20_000)]
    for w in words:  # pairs of tokens are known from here on
        b.encode_bytes(f" {w}".encode())
    tracemalloc.start()
    b.encode(" ".join(words))
    pieces = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert pieces < 200 * len(words)
    held = []
    monkeypatch.setattr(bpe, "text_or_empty", lambda values: held.append(len(values)) or values)
    assert list(bpe.texts_of(pa.array(words))) == words and max(held) <= 256


def test_bpe_keeps_results_when_generations_of_pieces_change(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 7)
    t = Tokenizer.from_file(bpe.default_tokenizer_path())
    b = bpe.Bpe(json.loads(open(bpe.default_tokenizer_path(), encoding="utf-8").read()))
    r = random.Random(4)
    for _ in range(200):
        s = prose(r.randrange(30), r)
        ids = t.encode(s, add_special_tokens=False).ids
        assert b.encode(s) == ids and b.decoded_text(b.ids_text(s)).decode() == t.decode(ids, skip_special_tokens=False)
        assert len(b.pieces) <= 7 and len(b.older) <= 7


# -- 4: Jaccard ---------------------------------------------------------------------------------------


def brute_components(rows, width, percent):
    word, low = re.compile(r"[^\x20\x09-\x0d]+"), {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, x in rows:
        w = word.findall(x.translate(low))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "percent", "piece"), [(3, 90, 256), (2, 60, 3)])
def test_jaccard_equals_brute_force(spark, docs, width, percent, piece, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", piece)
    got = jaccard.similar_components(docs, width, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == brute_components(pairs(docs), width, percent)


def test_jaccard_chain_and_empty(spark, empty):
    base = [f"w{k}" for k in range(60)]
    chain = [" ".join(base[: 40 + k]) for k in range(0, 20, 2)]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(chain)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.similar_components(d, 3, 90).collect()} == {0}
    assert jaccard.similar_components(empty).count() == 0
    assert jaccard.keep_one_each(d, 3, 90).count() == 1


def test_jaccard_of_near_copies_that_link_by_chance(spark, monkeypatch):
    """Texts from a few templates with random edits: about half of the pairs near the border link."""
    r = random.Random(21)
    rows = []
    for k in range(150):
        w = [f"t{k % 3}w{j}" for j in range(40)]
        for _ in range(r.randrange(4)):
            w[r.randrange(40)] = r.choice("abcdefgh")
        rows.append((k, " ".join(w[: r.randrange(36, 41)])))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for width, percent, piece in ((1, 90, 256), (3, 80, 7)):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        got = jaccard.similar_components(d, width, percent).select("doc_id", "n_shingles", "component_id").collect()
        assert collections.Counter(map(tuple, got)) == brute_components(rows, width, percent)


def test_template_pages_make_no_pairs(spark, monkeypatch):
    """Pages of one template, 15 per cent of each its own, don't link; the number of pairs that are looked at mustn't grow with their square."""
    seen = []
    plain = jaccard.linked
    monkeypatch.setattr(jaccard, "linked", lambda pairs, able, percent: seen.append(pairs.count()) or plain(pairs, able, percent))
    common = " ".join(f"c{k}" for k in range(68))
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(common), *(F.concat(F.lit(f" o{k}x"), F.col("id").cast("string")) for k in range(12))).alias("text"))
    got = jaccard.similar_components(d, 5, 80)
    assert got.where("component_id != doc_id").count() == 0 and got.count() == 3000
    assert sum(seen) <= 3000


def test_prefixes_keep_all_links():
    for percent in (60, 80, 90):
        for nx in range(1, 60):
            for ny in range(nx, 70):
                both = -(-percent * (nx + ny) // (100 + percent))  # the least intersection of a link
                index, probe = jaccard.prefix_lengths(nx, percent)[0], jaccard.prefix_lengths(ny, percent)[1]
                if both <= nx:  # beyond prefixes fewer tokens are left than a link needs
                    assert nx - index < both and ny - probe < both


def test_one_row_stays_whatever_ids_are(spark):
    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words, "x"]), " ".join(f"v{k}" for k in range(30))
    rows = [(1, text)] * 3 + [(2, near), (2, other), (None, other + " x"), (None, "alone in " + " ".join(words[::-1])), (None, "alone in " + " ".join(words[::-1])), (7, None), (7, None), (None, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.keep_one_each(d, 3, 90)
    assert got.columns == d.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([(1, text), (2, other), rows[6], (7, None), (7, None), (None, " ")])


def test_forest():
    r = np.random.default_rng(3)
    for n in (1, 5, 40):
        u, v = r.integers(0, 30, n), r.integers(0, 30, n)
        a, b = forest(u, v)

        def parts(us, vs):
            root = list(range(30))
            for x, y in zip(us.tolist(), vs.tolist(), strict=True):
                rx, ry = root[x], root[y]
                root = [min(rx, ry) if z in (rx, ry) else z for z in root]
            return root

        assert parts(u, v) == parts(a, b) and len(a) == 30 - len(set(parts(u, v))) and (b < a).all()


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(500, 501), (7, 7)], "a long, b long"))
    got = components(edges).collect()
    assert len(got) == 203 and len({r.label for r in got}) == 2
    assert components(edges.limit(0)).count() == 0


# -- 5: quality rules ---------------------------------------------------------------------------------


def brute_rules(x):
    word = re.compile(r"[^\x20\x09-\x0d]+")
    w = word.findall(x)
    lines = [v for v in x.split("\n") if word.search(v)]
    count = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {p for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_rules_equal_brute_force(spark, empty):
    loop = prose(12)
    some = [None, "", loop + " " + loop, loop + " x " + loop + " " + prose(90), "a b c d e f g h " * 30, "# | <x>\nl\nl\n \nl", prose(50) + "\n" + prose(3), "😀 漢字 " * 12]
    d = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.judge(d, labels).collect()}
    for i, x in enumerate(some):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(x or "")
        assert r.kept == (not r.base_failed and r.llr >= rules.THRESHOLD)
    assert {r.doc_id for r in rules.keep_good(d, labels).collect()} == {i for i, r in got.items() if r.kept}
    assert rules.judge(empty, labels).count() == 0 and rules.judge(d, labels.limit(0)).count() == len(some)
    assert {r.llr for r in rules.judge(d, None).collect()} == {0.0}
    brute_ratio(spark, some, {6}, got)


def brute_ratio(spark, some, trusted, got):
    """llr_sum and llr from counts of words and pairs, with Spark's hash of each."""
    word = re.compile(r"[^\x20\x09-\x0d]+")
    ws = [word.findall(x or "") for x in some]
    names = {w for x in ws for w in x}
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in names], "w string").selectExpr("w", "xxhash64(w) as h").collect()}
    pairs = {(h[a], h[b]) for x in ws for a, b in zip(x, x[1:], strict=False)}
    hp = {(r.a, r.b): r.h for r in spark.createDataFrame(list(pairs), "a long, b long").selectExpr("a", "b", "xxhash64(a, b) as h").collect()}
    grams = [[h[w] % rules.BUCKETS for w in x] + [hp[h[a], h[b]] % rules.BUCKETS for a, b in zip(x, x[1:], strict=False)] for x in ws]
    raw, good = collections.Counter(g for x in grams for g in x), collections.Counter(g for k in trusted for g in grams[k])
    n_raw, n_good = sum(raw.values()), sum(good.values())
    weight = {g: math.log((good[g] + rules.SMOOTHING) / (n_good * raw[g] / n_raw + rules.SMOOTHING)) for g in raw}
    for k, x in enumerate(grams):
        total = sum(weight[g] for g in x)
        assert got[k].llr_sum == pytest.approx(total, abs=1e-9) and got[k].llr == pytest.approx(total / max(1, len(x)), abs=1e-9)


def test_windows_with_one_hash_are_told_apart_by_words(spark, monkeypatch):
    """Hashes of runs that are all the same: windows are ordered by their words."""
    monkeypatch.setattr(rules, "chained", lambda hashes, apart: F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - apart, F.lit(0))), lambda h: F.lit(7).cast("long")))
    loop = prose(12)
    some = ["", loop + " " + loop, prose(60), loop + " x " + loop + " " + prose(30), "a b " * 20, prose(8), prose(9)]
    got = {r.doc_id: r.n_repeat_words for r in rules.judge(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), None).collect()}
    assert got == {k: brute_rules(x)[4] for k, x in enumerate(some)}


def test_ratio_finds_junk(spark):
    good = [(k, prose(60)) for k in range(40)]
    junk = [(100 + k, " ".join(w + "&&&" for w in prose(60).split())) for k in range(10)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(good + junk, "doc_id long, text string"), labels).collect()}
    assert min(got[k].llr for k, _ in good) > max(got[k].llr for k, _ in junk)


def test_rules_keep_other_columns(docs):
    more = docs.withColumn("a.b", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("ws", F.lit(2)).withColumn("weights", F.lit(2)).withColumn("llr", F.lit(2))
    got = rules.keep_good(more, None)
    assert got.columns == more.columns
    assert {r.n_words for r in got.collect()} == {"x"} and rules.keep_good(more.limit(0), None).count() == 0
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter(r.doc_id for r in rules.judge(docs, None).collect() if r.kept)


# -- 2: mixing ----------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark, docs, empty):
    rows = mixing.mix_sizes(docs).collect()
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))
    want = brute_targets(dict(size))
    taken = collections.Counter()
    by_size = {}
    for r in rows:
        taken[r.target] += r.taken
        by_size[r.target] = max(by_size.get(r.target, 0), r.size)
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
    assert sorted({round(r.target, 6) for r in rows}) == sorted({round(t, 6) for t in want.values()})
    for t, n in taken.items():
        assert abs(n - t * sum(abs(x - t) < 1e-6 for x in want.values())) <= by_size[t]
    again = mixing.mix_sizes(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix_sizes(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +collections.Counter({i: n for i, n in collections.Counter([r.doc_id for r in rows for _ in range(r.copies if r.size else 0)]).items()})


def brute_mix(rows, seed=""):
    """copies by document, one document after the other; rows have doc_id, text, source."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    total = collections.Counter()
    for (_, _, s), n in zip(rows, sizes, strict=True):
        total[s] += n
    out = [0] * len(rows)
    for s, target in brute_targets(dict(total)).items():
        own = [k for k, r in enumerate(rows) if r[2] == s and sizes[k]]
        # The factor by bisection: copies are the binary digits times it, two at most.
        lo, hi = 0.0, 4.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(sizes[k] * min(2, mid * sizes[k].bit_length()) for k in own) < target else (lo, mid)
        want = {k: min(2.0, hi * sizes[k].bit_length()) for k in own}
        for k in own:
            out[k] = int(want[k] + 1e-9)
        left = target - sum(sizes[k] * out[k] for k in own)
        odds = {}
        for k in own:
            p = want[k] - out[k]
            if p > 1e-9:
                u = (int(hashlib.md5(f"{seed}{'' if rows[k][0] is None else rows[k][0]} {rows[k][1] or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13  # noqa: S324
                odds.setdefault((u / (1 - u)) / (p / (1 - p)), []).append(k)
        for x in sorted(odds):
            if sum(sizes[k] for k in odds[x]) <= left + 1e-6:
                left -= sum(sizes[k] for k in odds[x])
                for k in odds[x]:
                    out[k] += 1
    return out


def mixed_docs():
    r = random.Random(9)
    return [(k, prose(int(r.paretovariate(0.8) * 4) % 700 + 1, r), f"s{k % 3}") for k in range(500)]


def test_mixing_equals_brute_force(spark):
    rows = mixed_docs()
    rows += [(7, rows[7][1], "s1"), (None, "a b c", None), (501, None, "s2")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for seed in ("", "x"):
        want = collections.Counter(zip((r[0] for r in rows), brute_mix(rows, seed), strict=True))
        assert collections.Counter((r.doc_id, r.copies) for r in mixing.mix_sizes(d, seed).collect()) == want


def test_inclusion_follows_the_odds(spark):
    """Over 100 seeds every size class is drawn about as often as its fraction says; without the division by inclusion odds classes would be drawn alike."""
    rows = mixed_docs()
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    base = mixing.measured(d)
    _, e = mixing.decisions(base)
    e = {(r.source, r.digits): r for r in e.collect()}
    size = {r.doc_id: r.size for r in base.collect()}
    seeds = range(100)
    drawn = collections.Counter()
    members = collections.Counter()
    for r in rows:
        members[r[2], size[r[0]].bit_length()] += 1
    for seed in seeds:
        for r, n in zip(rows, brute_mix(rows, str(seed)), strict=True):
            drawn[r[2], size[r[0]].bit_length()] += n
    fractions = set()
    for key, n in members.items():
        p, mean = e[key].p, drawn[key] / n / len(seeds)
        fractions.add(round(p, 3))
        # Filling up at the end takes short documents a little more often, and few long ones a little less.
        spread = 3 * math.sqrt(max(p * (1 - p), 0.01) / (n * len(seeds))) + (0.15 if n < 20 else 0.05)
        assert mean == pytest.approx(e[key].whole + p, abs=spread)
    assert len(fractions) > 5 and max(fractions) - min(fractions) > 0.3


# -- 1: toxicity --------------------------------------------------------------------------------------


def labelled(n, r):
    out = []
    for k in range(n):
        w = prose(r.randint(3, 120), r).split(" ")
        toxic = k % 5 == 0
        for _ in range(r.randint(2, 4) if toxic else 0):
            w[r.randrange(len(w))] = r.choice(["scumbag", "vilewretch" + r.choice(VOCABULARY), "idiotic"])
        out.append((" ".join(w), int(toxic)))
    return out


def test_toxicity_learns(spark, empty):
    r = random.Random(2)
    rows = [(k, t, y) for k, (t, y) in enumerate(labelled(700, r))]
    d = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(10_000, None), (10_001, ""), (10_002, "x " * 9000), (None, "scumbag")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(d, labels)
    got = {r.doc_id: (r.toxicity, r.held) for r in toxicity.score_documents(d, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [(got[k][0] >= toxicity.THRESHOLD, y) for k, _, y in rows if got[k][1]]
    assert sum(p == bool(y) for p, y in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s, _ in got.values()) and got[10_000][0] == got[10_001][0]
    assert bytes(toxicity.fitted(d.repartition(4), labels)) == bytes(model)
    # Of rows with one id the least text is learnt from, however rows lie.
    twice = d.union(d.where("doc_id = 5").withColumn("text", F.lit("zz scumbag")))
    assert [r.text for r in toxicity.sample(twice, labels.where("doc_id = 5 or doc_id = 8")).collect()] == [r.text for r in toxicity.sample(d, labels.where("doc_id = 5 or doc_id = 8")).collect()]
    assert toxicity.fit(d, labels.limit(0)) is None and toxicity.fit(empty, labels) is None
    nothing = toxicity.fitted(empty, labels)
    assert {x.toxicity for x in toxicity.score_documents(d, nothing).collect()} == {0.0}
    assert toxicity.score_documents(empty.select("doc_id", "text"), model).count() == 0
    kept = toxicity.drop_toxic(d.withColumn("toxicity", F.lit(5.0)).withColumn("a.b", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "toxicity", "a.b"] and {x.toxicity for x in kept.collect()} == {5.0}


def test_network_gradients():
    rng = np.random.default_rng(1)
    net = toxicity.Network(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, where, y = rng.standard_normal((9, toxicity.INPUT)), np.array([[0, 1, 2, 3, 4], [5, 6, 7, -1, -1], [8, 0, 0, 2, 1]]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(net.gates(x), where)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    logit, cache = net.forward(net.gates(x), where, keep=True)
    grads, dx = net.gradients(cache, np.where((where >= 0)[:, :, None], x[where], 0), 1 / (1 + np.exp(-logit)) - y)
    grads["x"] = np.zeros_like(x)
    np.add.at(grads["x"], where[where >= 0], dx[where >= 0])
    for k, v in (net.p | {"x": x}).items():
        at = tuple(rng.integers(s) for s in v.shape)
        was = v[at]
        v[at] = was + 1e-4
        up = loss()
        v[at] = was - 1e-4
        down = loss()
        v[at] = was
        assert (up - down) / 2e-4 == pytest.approx(grads[k][at], rel=1e-4, abs=1e-7)


def test_toxicity_score_by_a_plain_forward_pass():
    """A document's score, word by word in plain Python, from the model's weights."""
    r = random.Random(4)
    data = labelled(120, r)
    model = toxicity.train([t for t, _ in data], [y for _, y in data])
    p, h = model.net.p, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-v))

    def inputs(w):
        grams = {n: [] for n in (4, 5)}
        padded = f" {w.lower()} ".encode()
        for n in grams:
            for k in range(len(padded) - n + 1):
                v = int.from_bytes(padded[k : k + n], "big") * 0x9E3779B97F4A7C15 % 2**64
                grams[n].append((v >> (64 - toxicity.GRAM_BITS + 1)) | ((n & 1) << (toxicity.GRAM_BITS - 1)))
        both = grams[4] + grams[5]
        raw = np.frombuffer(w.encode(), np.uint8)
        word = int(toxicity.hashes(raw, np.array([0]), np.array([len(raw)]), True)[0])
        e = [float(model.gram_table[g]) for g in both]
        # Evidence of absent n-grams counts as 0, and so does that of 4-grams where 5-grams alone are asked for.
        fives = [float(model.gram_table[g]) for g in grams[5]] + [0.0] * len(grams[4])
        known = [float(model.word_table[word >> (64 - toxicity.WORD_BITS)]), max(e, default=0.0), max(fives, default=0.0), sum(e) / max(1, len(e)), min(len(raw), 20) / 20]
        vector = [float(v) for v in model.net.word_vectors[word % toxicity.WORD_VECTORS]]
        mean = [sum(float(model.net.gram_vectors[g % toxicity.GRAM_VECTORS][k]) for g in both) / max(1, len(both)) for k in range(toxicity.VECTOR)]
        return known + vector + mean

    def states(xs, side):
        s, out = [0.0] * h, []
        for x in xs:
            g = [sum(x[i] * float(p["Wx"][i, 3 * h * side + k]) for i in range(len(x))) + float(p["bx"][3 * h * side + k]) for k in range(3 * h)]
            u = [sum(s[i] * float(p["U"][side, i, k]) for i in range(h)) for k in range(3 * h)]
            z, q = [sig(g[k] + u[k]) for k in range(h)], [sig(g[h + k] + u[h + k]) for k in range(h)]
            n = [math.tanh(g[2 * h + k] + q[k] * u[2 * h + k]) for k in range(h)]
            s = [(1 - z[k]) * n[k] + z[k] * s[k] for k in range(h)]
            out.append(s)
        return out

    def logit(ws):
        pad = [[0.0] * toxicity.INPUT] * (toxicity.WINDOW - len(ws))
        xs = [inputs(w) for w in ws] + pad
        both = [a + b for a, b in zip(states(xs, 0), reversed(states(xs[::-1], 1)), strict=True)][: len(ws)]
        at = [sum(math.tanh(sum(v[i] * float(p["A"][i, k]) for i in range(2 * h)) + float(p["a"][k])) * float(p["v"][k]) for k in range(8)) for v in both]
        top = max(at)
        weight = [math.exp(a - top) for a in at]
        return sum(w * sum(v[i] * float(p["w"][i]) for i in range(2 * h)) for w, v in zip(weight, both, strict=True)) / sum(weight) + float(p["b"][0])

    for text in (data[0][0], data[1][0], "One Idiotic word", prose(45)):
        ws = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)
        starts = [k for k in range(0, max(1, len(ws)), toxicity.STRIDE) if k == 0 or k < len(ws) - toxicity.WINDOW + toxicity.STRIDE]
        logits = sorted((logit(ws[k : k + toxicity.WINDOW]) for k in starts), reverse=True)
        z = np.dot(model.scale, [logits[0], logits[min(1, len(logits) - 1)], math.log(len(logits)), 1])
        assert model.scores(pa.array([text]))[0] == pytest.approx(sig(max(-30, min(30, z))), rel=1e-3, abs=1e-5)


def test_windows_cover_all_words():
    at = np.array([0, 0, 1, 33, 200])
    first, past, text = toxicity.window_places(at)
    for k in range(4):
        covered = {w for a, b, t in zip(first, past, text, strict=True) if t == k for w in range(a, min(a + toxicity.WINDOW, b))}
        assert covered == set(range(at[k], at[k + 1]))


# -- 6: HTML ------------------------------------------------------------------------------------------


def test_html_text(spark):
    net = html_text.trained()
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now.</div>
    <article><h1>Head&nbsp;line</h1><p>One <b>bo</b>ld &lt;tag&gt; text,\n with   space.<p>Second &amp; last para of it.<br>After break.</article>
    <section class="comments"><h3>Comments</h3><p>I liked it.</p></section><form class="subscribe"><label>Mail</label><input><button>Send</button></form><footer>&copy; site</footer></body></html>"""
    got = html_text.extract([page], net)[0]
    assert got == "Head line One bold <tag> text, with space. Second & last para of it. After break."
    rng = np.random.default_rng(123)
    right = total = 0
    for _ in range(60):
        made, label = html_text.made_page(rng)
        found = html_text.blocks(made)
        if len(found) == len(label):
            right += int((net.label([found])[0] == np.array(label)).sum())
            total += len(label)
    assert right / total > 0.97
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "just text"), (5, "u", "<p>" * 3000 + "deep"), (6, "u", "<article><p>" + "long text here. " * 20000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = {r.page_id: r for r in html_text.extract_pages(d).collect()}
    assert out[1].text == got and out[2].text == "" and out[3].n_chars == 0 and len(out) == 6
    assert html_text.extract_pages(d.limit(0)).count() == 0


def test_html_after_unclosed_and_self_closed_elements():
    texts = lambda page: [t for _, t, _ in html_text.blocks(page)]
    for tag in ("<svg class='i'/>", "<math />", "<svg>", "<iframe src='x'>", "<object>", "<noscript>", "<template>"):
        assert texts(f"<p>One {tag}two.</p><p>Three.</p>") == ["One two.", "Three."]
    assert texts("<p>One <svg/>two <svg><title>no</title></svg>three.</p>") == ["One two three."]
    assert texts("<p>One</p><iframe>no</iframe><p>two</p><script>no <p>no</p>") == ["One", "two"]
    assert texts("<iframe>" * 20000 + "end") == ["end"]


def test_html_work_is_in_proportion_to_the_page(spark):
    began = time.perf_counter()
    deep = html_text.blocks("<div>x" * 100_000)
    assert len(deep) == 100_000 and len(deep[-1][0]) == html_text.DEPTH
    assert len(html_text.blocks("<b>x" * 50_000 + "</i>" * 50_000 + "<p>y</p>" * 10)) == 11
    assert time.perf_counter() - began < 20
    d = spark.createDataFrame([(1, "u", "<div>" * 20_000 + "deep text", 1, 2, 3)], "page_id long, url string, html string, n_chars int, `a.b` int, lang int")
    assert html_text.extract_pages(d).columns == ["page_id", "url", "text", "n_chars"] and html_text.extract_pages(d).count() == 1


def test_html_on_the_small_table(spark):
    for r in html_text.op6_html_extraction(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


# -- 7: licences --------------------------------------------------------------------------------------


def test_licenses(spark, docs, empty):
    some = {
        1: "Under the MIT\n-License; mit license", 2: "apache license, GNU General Public License.", 3: "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", 4: "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0",
        5: None, 6: "", 7: "submit licensed mit", 8: "SPDX-License-Identifier: AND (", 9: "x " * 5000 + "mit license",
    }
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(some.items()), "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (6, 2, 2, 4, "mit")
    assert (got[2].base_labels, got[2].first_word, got[2].last_word) == ("apache,gpl", 0, 3)
    assert got[3].labels == "apache,bsd,mit" and got[3].base_labels == "" and got[4].labels == "gpl"
    assert got[5].n_words == 0 and got[5].first_word is None and got[6].labels == "" and got[7].n_base == 0 and got[8].labels == "" and got[9].first_word == 5000
    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {c: c + 32 for c in range(65, 91)}
    assert sorted(r.n_words for r in licenses.scan_licenses(docs).collect()) == sorted(len(word.findall(x.translate(low))) for _, x in pairs(docs))
    assert licenses.scan_licenses(empty).count() == 0


def test_base_columns_equal_brute_force(spark):
    r = random.Random(8)
    parts = ["mit", "license", "License", "MIT", "apache", "general", "public", "gnu", "x", "submit", "licensed", " ", "\n", "-", ", ", "(c) ", "é", "漢", "\x00", "mit license", "apache license.", "GENERAL public\tLICENSE"]
    some = [(k, r.choice([" ", "", "-"]).join(r.choice(parts) for _ in range(r.randrange(40)))) for k in range(200)] + [(200, None), (201, "w " * 30000 + "mit license"), (5, "mit license"), (None, "apache license")]
    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {c: c + 32 for c in range(65, 91)}
    want = collections.Counter()
    for i, x in some:
        w = word.findall((x or "").translate(low))
        places = [(k, label) for k in range(len(w)) for phrase, label in licenses.BASE.items() if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        want[i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in places}))] += 1
    d = spark.createDataFrame(some, "doc_id long, text string").withColumn("labels", F.lit(1)).withColumn("a.b", F.lit(1))
    got = licenses.scan_licenses(d).collect()
    assert collections.Counter((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got) == want
    assert all(set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1 for g in got)


def test_expressions_after_tags():
    finder = licenses.automaton()
    labels = lambda text: licenses.scan_text(text, finder)[5]
    for text, want in {
        "license expression\nMIT": "mit", "SPDX-License-Identifier:\n MIT": "mit", "é 漢 SPDX-License-Identifier: (GPL-2.0 OR\n MIT)\nand then some": "gpl,mit", "license expression: MIT\nAND BSD-3-Clause\nor prose": "bsd,mit",
        "License-Expression Apache-2.0 AND": "apache", "license expression": "", "license expression\n": "", "a license expression: ISC. SPDX license identifier: MPL-2.0 WITH x": "isc,mpl", "license expressions MIT": "", "SPDX-License-Identifier: ((MIT": "mit",
    }.items():
        assert labels(text) == want, text


def test_expressions():
    assert licenses.parse("MIT OR GPL-2.0 AND BSD") == ["MIT", "GPL-2.0", "BSD", "and", "or"]
    assert licenses.evaluate(licenses.parse("MIT OR GPL-2.0")) == ({"mit", "gpl"}, True)
    assert licenses.evaluate(licenses.parse("MIT AND GPL-2.0")) == ({"mit", "gpl"}, False)


# -- 8: resampling ------------------------------------------------------------------------------------


def test_resampling(spark, empty):
    good = [(k, prose(60)) for k in range(80)]
    junk = [(100 + k, " ".join(w.upper() + "!!" for w in prose(60).split())) for k in range(20)]
    d = spark.createDataFrame([*good, *junk, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(10)], "doc_id long, quality int, toxic int")
    got = resampling.resample(d, labels).collect()
    assert sum(r.kept for r in got) == math.ceil(0.8 * 102)
    assert sum(r.kept for r in got if r.doc_id < 100) >= 78
    key = sorted((r.gumbel_key for r in got), reverse=True)[math.ceil(0.8 * 102) - 1]
    assert all(r.kept == (r.gumbel_key >= key) for r in got)
    assert resampling.resample(empty, labels).count() == 0 and all(r.kept for r in resampling.resample(d, None).collect())


def test_log_weight_equals_brute_force(spark, docs):
    """Sums of log ratios by the model's buckets, with repeated rows, nulls, a long text and clashing columns."""
    labels = spark.createDataFrame([(k, 1, 0) for k in range(25)] + [(30, 0, 0)], "doc_id long, quality int, toxic int")
    d = docs.withColumn("log_weight", F.lit("x")).withColumn("a.b", F.lit(1))
    got = resampling.resample(d, labels).collect()
    rows = pairs(docs)
    word, low = re.compile(r"[^\x20\x09-\x0d]+"), {c: c + 32 for c in range(65, 91)}
    grams = []
    for _, x in rows:
        w = [v.encode() for v in word.findall(x.translate(low))]
        h = [int(resampling.hashes(np.frombuffer(v, np.uint8), np.array([0]), np.array([len(v)]), True)[0]) for v in w]
        both = [int(resampling.mix(np.array([a], np.uint64) ^ (np.array([b], np.uint64) * np.uint64(0x9FB21C651E98DF25)))[0]) for a, b in zip(h, h[1:], strict=False)]
        grams.append([g % resampling.BUCKETS for g in h + both])
    raw, good = collections.Counter(g for x in grams for g in x), collections.Counter(g for (i, _), x in zip(rows, grams, strict=True) if i is not None and i < 25 for g in x)
    n_raw, n_good, s = sum(raw.values()), sum(good.values()), resampling.SMOOTHING
    weight = {g: math.log((good[g] + s) / (n_good * raw[g] / n_raw + s)) for g in raw}
    want = sorted((i is None, i or 0, round(sum(weight[g] for g in x), 6)) for (i, _), x in zip(rows, grams, strict=True))
    assert sorted((g.doc_id is None, g.doc_id or 0, round(g.log_weight, 6)) for g in got) == want
    assert sum(g.kept for g in got) == math.ceil(25 / 26 * len(rows))


def test_top_k_splits_ties_by_id(spark):
    rows = [(k, 1.0) for k in range(50)] + [(3, 1.0)] * 20 + [(None, 1.0)] * 10 + [(60, 2.0), (61, 0.0)]
    d = spark.createDataFrame(rows, "doc_id long, x double").repartition(5)
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for k in (1, 2, 5, 10, 30, 60, 75, 80, 81, 82, 90):
        got = resampling.top_k(resampling.cut(d), k, "x").collect()
        assert len(got) == len(rows) and sorted((r.x, r.doc_id or -1) for r in got if r.kept) == sorted((x, i or -1) for i, x in order[:k])


def test_top_k_of_ties(spark):
    rows = spark.createDataFrame([(k % 7, float(k % 3)) for k in range(60)], "doc_id long, x double")
    for k in (0, 1, 20, 21, 59, 60):
        assert resampling.top_k(rows, k, "x").where("kept").count() == k or k == 0


# -- 9: fingerprints ----------------------------------------------------------------------------------


def test_fingerprints(spark, docs, empty):
    some = list(enumerate(texts()))
    distinct = spark.createDataFrame(some, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprint.compare_edited(distinct).collect()}
    order = sorted(((k, t or "") for k, t in some), reverse=True)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 2
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(fingerprint.canonical(t) == fingerprint.canonical(edited)) and r.near_next == float(fingerprint.canonical(t) == fingerprint.canonical(after))
    groups = collections.defaultdict(set)
    for i, t in pairs(docs):
        groups[fingerprint.canonical(t)].add(i)
    count = collections.Counter(fingerprint.canonical(t) for _, t in pairs(docs))
    for r in fingerprint.copy_groups(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        c = fingerprint.canonical(r.text or "")
        assert r.copies == count[c] and r.first_id == min(x for x in groups[c] if x is not None)
    assert fingerprint.compare_edited(docs).count() == docs.count() and fingerprint.compare_edited(empty).count() == 0 and fingerprint.copy_groups(empty).count() == 0
    one = fingerprint.compare_edited(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and one.near_next == 1.0


def test_fingerprints_that_collide(spark):
    """One digest for all texts: groups are made by their bytes."""
    rows = [(1, "same"), (2, "Other"), (3, " SAME "), (4, "same"), (4, "other"), (None, "third")]
    got = fingerprint.fingerprint_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), lambda data: "0").collect()
    assert sorted(((r.doc_id or 9), r.first_id or 9, r.copies) for r in got) == [(1, 1, 3), (2, 2, 2), (3, 1, 3), (4, 1, 3), (4, 2, 2), (9, 9, 1)]
    half = fingerprint.fingerprint_table(spark.createDataFrame(rows, "doc_id long, text string"), lambda data: str(data == b"third")).collect()
    assert sorted(((r.doc_id or 9), r.first_id or 9, r.copies) for r in half) == [(1, 1, 3), (2, 2, 2), (3, 1, 3), (4, 1, 3), (4, 2, 2), (9, 9, 1)]


def test_parts_of_many_bounds(spark):
    d = spark.range(1000).selectExpr("id * 7 - 500 as doc_id", "cast(id as string) as text").union(spark.createDataFrame([(None, "n")], "doc_id long, text string"))
    for parts in (1, 2, 3, 10, 50):
        rows = fingerprint.with_next(d, parts).collect()
        own = [(r.part, r.doc_id) for r in rows if not r.guest]
        assert len(own) == 1001 and sorted(own, key=lambda r: (r[0], r[1] is None, -(r[1] or 0))) == sorted(own, key=lambda r: (r[1] is None, -(r[1] or 0)))


def test_canonical():
    assert fingerprint.canonical("  Ａ\tSTRASSE ﬁ\n") == fingerprint.canonical("a straße fi")
    assert fingerprint.canonical(fingerprint.canonical("ǅ Ⅷ")) == fingerprint.canonical("ǅ Ⅷ")


# -- 10: urls -----------------------------------------------------------------------------------------


def brute_rank(seeds, edges, rounds=urls.ROUNDS, d=urls.DAMPING):
    out = collections.Counter(a for a, _ in edges)
    state = dict(seeds)
    for _ in range(rounds):
        flow = collections.Counter()
        for a, b in edges:
            flow[b] += state.get(a, 0.0) / out[a]
        held = 1 - sum(flow.values())
        state = {h: (1 - d) * s + d * (flow[h] + held * s) for h, s in seeds.items()}
    return state


def test_urls(spark):
    link = lambda *hosts: "".join(f"<a class='x' href=\"https://{h}/p\">t</a>" for h in hosts)
    rows = [
        (1, "https://A.example.org/es/1?x", link("b.net", "c.net")), (2, "http://a.example.org/es/2", None), (3, "http://example.org/en/12#f", link("a.example.org")), (4, "http://www.x.com/fr/a", link("b.net")), (5, "http://x.com/de/", ""),
        (6, "https://b.net/", link("a.example.org", "b.net") + "<A HREF='//d.net'>"), (7, None, link("b.net")), (8, "no scheme", None), (9, "http://d.net?q", "<a href=/local>"), (10, "x://other.org", None), (9, "http://d.net?q", None),
    ]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge_pages(d).collect()}
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in (1, 3, 4, 5)] == [("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("www.x.com", "/fr/a", "com/fr/", "allow"), ("x.com", "/de/", "com/de/", "block")]
    assert (got[7].host, got[7].path, got[7].rule) == ("", "", None) and got[8].host == "" and (got[9].host, got[9].path) == ("d.net", "") and got[10].rule is None
    edges = {(a, b) for a, b in [("a.example.org", "b.net"), ("a.example.org", "c.net"), ("example.org", "a.example.org"), ("www.x.com", "b.net"), ("b.net", "a.example.org"), ("b.net", "d.net")]}
    hosts = {"a.example.org", "b.net", "c.net", "example.org", "www.x.com", "x.com", "d.net", "other.org", ""}
    bad = {h: 1 / 3 * (h in ("a.example.org", "example.org", "x.com")) for h in hosts}
    want = brute_rank(bad, {(b, a) for a, b in edges})
    for r in got.values():
        assert r.distrust == pytest.approx(want[r.host] * len(hosts))
    assert got[6].verdict == ("block" if got[6].distrust > got[6].trust and got[6].distrust >= 1 else "allow")
    assert urls.judge_pages(d.limit(0)).count() == 0


def test_scores_and_verdicts_equal_brute_force(spark, tmp_path):
    """Through the registered query: trust, distrust and verdict of a table with many hosts, a hub, repeated rows, nulls and clashing columns."""
    r = random.Random(12)
    hosts = [f"h{k}.net" for k in range(60)] + ["hub.net"] + [f"s{k}.example.org" for k in range(6)] + [f"t{k}.com" for k in range(6)]
    rows = []
    for k in range(300):
        h = r.choice(hosts)
        to = [r.choice(hosts) for _ in range(r.randrange(4))] + ["hub.net"] * (k % 3 == 0)
        path = r.choice(["/", "/es/1", "/en/12", "/fr/x", "/de/y", ""])
        rows.append((k, f"http://{h.upper() if k % 7 == 0 else h}{path}", "".join(f"<a href='http://{x}/z'>x</a>" for x in to) + "<a href='/own'>y</a>"))
    rows += [rows[0], rows[1], (300, None, "<a href='http://hub.net/'>x</a>"), (301, "no", None), (302, "http://hub.net/" + "x" * 50_000, "y" * 200_000 + "<a href='//h1.net'>z</a>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("trust", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(3)
    d.write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.op10_url_filters(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)

    def rule(host, path):
        fit = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1] if fit else None

    parts = []
    for i, u, x in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        parts.append((i, m[1].lower() if m else "", m[2] if m else "", x or ""))
    edges = {(h, to) for _, h, _, x in parts for to in re.findall(r"<a href='(?:http:)?//([^/']*)", x) if h and to != h}
    count, balance = collections.Counter(), collections.Counter()
    for _, h, p, _ in parts:
        count[h] += 1
        balance[h] += {"allow": 1, "block": -1, None: 0}[rule(h, p)]
    names = {*count, *(h for e in edges for h in e)}
    share = {h: balance[h] / count[h] if count[h] else 0.0 for h in names}
    good, bad = {h: max(0.0, share[h]) for h in names}, {h: max(0.0, -share[h]) for h in names}
    norm = lambda s: {h: v / sum(s.values()) for h, v in s.items()}
    trust, distrust = brute_rank(norm(good), edges), brute_rank(norm(bad), {(b, a) for a, b in edges})
    seen = collections.Counter()
    for g in got:
        _, host, path, _ = next(p for p in parts if p[0] == g.page_id)
        assert (g.host, g.path) == (host, path)
        assert g.trust == pytest.approx(trust[host] * len(names)) and g.distrust == pytest.approx(distrust[host] * len(names))
        by_method = "block" if distrust[host] > trust[host] and distrust[host] * len(names) >= urls.THRESHOLD else "allow"
        assert g.verdict == (rule(host, path) or by_method)
        seen[rule(host, path) is None, g.verdict] += 1
    assert seen[True, "block"] and seen[True, "allow"]


def test_distrust_reaches_along_a_long_chain(spark):
    # h0 > h1 > ... > h14, the last of which is blocked; many other hosts make an even share small
    rows = [(k, f"http://h{k}.net/", f"<a href='http://h{k + 1}.net/'>x</a>" if k < 14 else None) for k in range(15)]
    d = spark.createDataFrame([*rows, *((k, f"http://other{k}.net/", None) for k in range(15, 150))], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge_pages(d, rules=(("block", "h14.net", "/"),)).collect()}
    held = sum(0.85**k for k in range(15))
    for k in range(15):
        assert got[k].distrust == pytest.approx(150 * 0.85 ** (14 - k) / held)
    assert all(got[k].verdict == "block" for k in range(15)) and got[20].distrust == 0 and got[20].verdict == "allow"


# -- shared pieces ------------------------------------------------------------------------------------


def test_byte_words():
    from quernel.llm.bytehash import chunks, hashes, words

    some = ["a bb", "", " Bb  cc", "cc", "é 漢", "x" * 50]
    seen = {}
    for most in (1, 7, 1 << 20):
        out = []
        for first, last, data, offsets in chunks(pa.array(some), most):
            starts, ends, at = words(data, offsets, True)
            h = hashes(data, starts, ends, True)
            for k in range(last - first):
                out.append(h[at[k] : at[k + 1]].tolist())
        for t, hs in zip(some, out, strict=True):
            assert len(hs) == len(t.split())
            for w, v in zip(t.lower().split(), hs, strict=True):
                assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)
