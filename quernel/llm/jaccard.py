"""N-gram Jaccard join: documents whose shingle sets are alike, by prefix filters under several orders.

Two sets with Jaccard similarity of at least t share at least 2t / (1 + t) of the smaller one's tokens and t of the
larger one's. So, whatever global order tokens stand in, the smaller one's first n - ceil(2t / (1 + t) n) + 1 tokens
(its index prefix) and the larger one's first n - ceil(t n) + 1 (its probe prefix) have a token in common. Here three
orders are used, all with tokens that occur in one set only first: then by frequency, or by one of two hashes. A
pair is verified only if it passes the filter in all three.

1. One pass over the texts gives each document's set, as hashes. Equal sets are one *class*.
2. Tokens meet by token range; those of at least two classes (shared tokens) go on with a frequency band.
   A token of only one class can't be in an intersection, and comes first in each order, so that it only
   shortens the part of the prefix that matters. Of two sets of like size that each have more than
   (1 - t) / (1 + t) of their tokens for themselves neither has an index prefix: they never meet.
3. Shared tokens meet by class, and give prefixes. Prefix tokens under the order by frequency are *posts*.
4. Posts meet by token, but not all pairs of them: a *star* joins one class of each token's list to the others.
   Pairs that pass the filters of all orders and of sizes are verified, and links contracted to components; a
   list within one component is done.
5. Open lists that have a class in common make a *family*. The classes outside its largest component are compared
   with all of it, in pieces of ``PIECE`` classes, a task a pair of pieces. In a task pairs of different
   components are filtered by the prefixes of all orders, then intersections are counted exactly; a task puts out
   links that join what it hasn't yet joined. Then every pair that could link is in one component or was looked at.
6. Links are contracted to components; each gets its smallest doc_id.

Nothing is capped or sampled. Work beyond step 3 is in proportion to the posts, but for step 5, which for a family
of m classes, r of them outside its largest component, moves 2 r m / PIECE classes and filters r m pairs: near
copies that mostly link cost little, a family of many classes that share rare tokens without linking is quadratic.

Input cases: null text or a text without words has an empty set and links with nothing; a text with fewer than
``width`` words has its whole sequence as its one token; repeated rows, equal doc_ids included, are members of one
class; null doc_ids take part, but never are a component's smallest; extra columns are ignored, and kept by
``keep_one_each`` whatever their names; an empty table gives an empty result. Tokens are 64-bit hashes, and 48 bits
of them from step 2 on: two sets are compared by 48 bits, which for sets of n tokens mistakes one token for another
with a probability of about n * n / 2**48 a pair. Sets count as equal if 63-bit hashes of their sorted tokens are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.bytehash import chunks, hashes, mix, words
from quernel.llm.common import cut, drop, ship, table
from quernel.llm.components import components

_U = np.uint64
#: Classes that one verifying task takes from each of two pieces of a family.
PIECE = 256
#: Parts in which a family's classes meet what is known of the family.
SALTS = 32
#: Tokens that a map task gathers before it deals them out.
FLUSH = 4_000_000
#: Multipliers of the three orders' hashes; the first order is by frequency, its hash parts equal ones.
ORDERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def token_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its set: sorted distinct 64-bit shingle hashes. A to Z count as a to z."""
    for first, last, data, offsets in chunks(texts):
        starts, ends, at = words(data, offsets, True)
        h = hashes(data, starts, ends, True)
        m = max(0, len(h) - width + 1)
        s = np.zeros(m, np.uint64)
        for k in range(width):
            s = mix((s ^ h[k : k + m]) * _U(0x9FB21C651E98DF25) + _U(k + 1))
        for k in range(last - first):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= width:
                yield np.unique(s[a : b - width + 1])
            elif b > a:
                yield mix(np.array([int(xxhash.xxh3_64_intdigest(h[a:b].tobytes()))], np.uint64) + _U(b - a))
            else:
                yield h[:0]


def signature(tokens: np.ndarray) -> int:
    """A set's 64-bit name; positive, 0 only for the empty set."""
    return (xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1) or 1 if len(tokens) else 0


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays after a header with their sizes and types."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.nbytes, {"u1": 0, "u2": 1, "u4": 2, "u8": 3, "i8": 4}[a.dtype.str[1:]]))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8), 8 + 16 * n, []
    for k in range(n):
        kind = ["<u1", "<u2", "<u4", "<u8", "<i8"][head[2 * k + 1]]
        out.append(np.frombuffer(data, kind, int(head[2 * k]) // np.dtype(kind).itemsize, at))
        at += int(head[2 * k])
    return out


def _pack_sorted(tokens: np.ndarray) -> list[np.ndarray]:
    """Sorted tokens as a first one and gaps, in four bytes each where these suffice."""
    if not len(tokens):
        return [tokens, np.zeros(0, np.uint32)]
    gaps = np.diff(tokens)
    return [tokens[:1], gaps.astype(np.uint32) if not len(gaps) or gaps.max() < 2**32 else gaps]


def _unpack_sorted(first: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([first.astype(np.uint64), gaps.astype(np.uint64)]), dtype=np.uint64)


_BLOCK = "part int, kind int, payload binary"


def _block_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "payload"])


def _some(rows: Iterator[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size >= most:
            yield _block_rows(held)
            held, size = [], 0
    if held:
        yield _block_rows(held)


def _deal(parts: int, width: int):
    """Step 1 for a map task: kind 1 rows (documents, by class) and kind 0 rows (tokens, by token range)."""

    def flush(ids, nulls, sigs, sets, given: set[int]):
        sig, n = np.array(sigs, np.uint64), np.array([len(s) for s in sets], np.int64)
        where = (sig % _U(parts)).astype(np.int64)
        for p in np.unique(where):
            k = where == p
            yield int(p), 1, _pack(np.array(ids, np.int64)[k], np.array(nulls, np.uint8)[k], sig[k], n[k])
        fresh = [k for k, s in enumerate(sigs) if s and s not in given and not given.add(s)]
        if not fresh:
            return
        token = np.concatenate([sets[k] for k in fresh]) >> _U(16)
        owner = np.repeat(np.arange(len(fresh), dtype=np.uint32), n[fresh])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        own = sig[fresh]
        bounds = np.searchsorted(token, (np.arange(parts + 1, dtype=np.float64) * (2.0**48 / parts)).astype(np.uint64))
        bounds[-1] = len(token)
        for p in range(parts):
            a, b = int(bounds[p]), int(bounds[p + 1])
            if b > a:
                here, k = np.unique(owner[a:b], return_inverse=True)
                yield p, 0, _pack(*_pack_sorted(token[a:b]), own[here], k.astype(np.uint16 if len(here) < 65536 else np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            ids, nulls, sigs, sets, size, given = [], [], [], [], 0, set()
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for key, s in zip(keys, token_sets(batch.column(1), width), strict=True):
                    ids.append(key or 0)
                    nulls.append(key is None)
                    sigs.append(signature(s))
                    sets.append(s)
                    size += len(s)
                    if size >= FLUSH:
                        yield from flush(ids, nulls, sigs, sets, given)
                        ids, nulls, sigs, sets, size = [], [], [], [], 0
                        if len(given) > 1_000_000:
                            given.clear()
            if ids:
                yield from flush(ids, nulls, sigs, sets, given)

        yield from _some(rows())

    return run


def _meet_tokens(parts: int):
    """Step 2 for a token range: shared tokens go to their classes' parts; documents pass on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, own = [], []
        for batch in batches:
            for part, kind, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if kind == 1:
                    yield _block_rows([(part, 1, payload)])
                else:
                    first, gaps, sigs, k = _unpack(payload)
                    token.append(_unpack_sorted(first, gaps))
                    own.append(sigs[k])
        if not token:
            return
        t, c = np.concatenate(token), np.concatenate(own)
        del token, own
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])
        t, c = t[new], c[new]
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        count = np.diff(np.append(begin, len(t)))
        df = np.repeat(count, count)
        t, c, df = t[df > 1], c[df > 1], df[df > 1]
        band = np.minimum(255, 4 * np.log2(df)).astype(np.uint8)
        where = (c % _U(parts)).astype(np.int64)
        order = np.lexsort((t, c, where))
        t, c, band, where = t[order], c[order], band[order], where[order]
        bounds = np.searchsorted(where, np.arange(parts + 1))

        def rows():
            for p in range(parts):
                a, b = int(bounds[p]), int(bounds[p + 1])
                if b > a:
                    sig, n = np.unique(c[a:b], return_counts=True)
                    yield p, 0, _pack(sig, n.astype(np.uint16 if n.max() < 65536 else np.uint32), t[a:b], band[a:b])

        yield from _some(rows())

    return run


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Tokens of the index prefix and of the probe prefix of a set of n, for a similarity of percent / 100."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


_CLASS = "kind int, doc_id long, sig long, n long, shared int, indexed int, tokens binary, others binary, posts array<long>"


def _meet_classes(percent: int):
    """Step 3 for a part of the classes: rows of kind 1 (documents) and kind 0 (classes that may link, with their prefixes)."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = ["kind", "doc_id", "sig", "n", "shared", "indexed", "tokens", "others", "posts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size: dict[int, int] = {}
        sigs, counts, tokens, bands = [], [], [], []

        def classes_of(rows: list[tuple]):
            columns = zip(*((0, None, *r) for r in rows), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got = _unpack(payload)
                if kind == 1:
                    ids, nulls, sig, n = got
                    size |= dict(zip(sig.tolist(), n.tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(sig), np.int32)), pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(sig.astype(np.int64)), pa.array(n), *(pa.nulls(len(sig), k) for k in kinds[4:])], names=names)
                else:
                    sigs.append(np.repeat(got[0], got[1]))
                    tokens.append(got[2])
                    bands.append(got[3])
        if not sigs:
            return
        s, t, band = np.concatenate(sigs), np.concatenate(tokens), np.concatenate(bands)
        del sigs, tokens, bands
        order = np.argsort(s, kind="stable")
        s, t, band = s[order], t[order], band[order]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        out: list[tuple] = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(s)], strict=True):
            n = size[int(s[a])]
            # What of the prefixes is left for shared tokens, as the others come first.
            index, probe = (max(0, q - (n - (b - a))) for q in prefix_lengths(n, percent))
            if probe < 1:
                continue
            own = np.sort(t[a:b])
            hashed = [mix(own * _U(by)) for by in ORDERS]
            first = np.lexsort((hashed[0], band[a:b][np.argsort(t[a:b], kind="stable")]))[:probe]
            others = [own[np.argsort(h)[:probe]] for h in hashed[1:]]
            out.append((int(s[a]), n, b - a, min(index, b - a), own.tobytes(), np.concatenate(others).tobytes(), own[first].astype(np.int64)))
            if len(out) >= 500:
                yield classes_of(out)
                out = []
        if out:
            yield classes_of(out)

    return run


def _verify(percent: int):
    """Of pairs (x the smaller class, y the larger) those that pass the other orders' filters and link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = {name: batch.column(k).to_pylist() if name not in ("xt", "yt", "xo", "yo") else batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(columns[c][k].as_buffer(), np.uint64) for c in ("xo", "yo"))
                index, nx, ny = columns["xi"][k], columns["xn"][k], columns["yn"][k]
                passes = all(not set(x[a : a + index].tolist()).isdisjoint(y[b : b + len(y) // 2].tolist()) for a, b in ((0, 0), (len(x) // 2, len(y) // 2)))
                if passes:
                    both = len(np.intersect1d(*(np.frombuffer(columns[c][k].as_buffer(), np.uint64) for c in ("xt", "yt")), assume_unique=True))
                    if 100 * both >= percent * (nx + ny - both):
                        keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return run


def _may_link(percent: int) -> str:
    """SQL condition on two posts of a token, x and y: sizes and shared tokens allow a link, and the smaller one's post is in its index prefix."""
    both = "least(x.shared, y.shared)"
    return f"100 * {both} >= {percent} * (x.n + y.n - {both}) and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and if(struct(x.n, x.sig) < struct(y.n, y.sig), x.indexed, y.indexed)"


#: Two classes as a pair with the smaller one first.
_PAIR = ("if(struct(x.n, x.sig) < struct(y.n, y.sig), x.sig, y.sig) as x", "if(struct(x.n, x.sig) < struct(y.n, y.sig), y.sig, x.sig) as y")


def linked(pairs: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (x, y) that link; able has the classes' tokens."""
    side = lambda c: able.select(F.col("sig").alias(c), *(F.col(old).alias(c + new) for old, new in (("n", "n"), ("indexed", "i"), ("tokens", "t"), ("others", "o"))))
    full = pairs.join(side("x").hint("merge"), "x").join(side("y").hint("merge"), "y")
    return full.select("x", "y", "xn", "yn", "xi", "xt", "yt", "xo", "yo").mapInArrow(_verify(percent), "a long, b long")


def _shares(prefixes: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix left x right: whether two classes have a token in common in their prefixes."""
    values, at = np.unique(np.concatenate(prefixes), return_inverse=True)
    owner = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
    # Only tokens of two or more classes matter; the matrices then stay narrow.
    keep = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(keep) - 1
    use = keep[at]
    out = np.zeros((len(left), len(right)), bool)
    owner, column = owner[use], column[at[use]]
    for a in range(0, int(keep.sum()), 4096):
        k = (column >= a) & (column < a + 4096)
        m = np.zeros((len(prefixes), 4096), np.float32)
        m[owner[k], column[k] - a] = 1
        out |= m[left] @ m[right].T > 0
    return out


def _verify_blocks(percent: int):
    """Step 5 for one task: the links between a piece of the classes outside the main component and a piece of all."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "n", "sig"])
        sig, n, shared, part, out, side = (pdf[c].to_numpy() for c in ("sig", "n", "shared", "part", "outside", "side"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: list[tuple[int, int]] = []
        most = np.minimum.outer(shared[left], shared[right])
        ok = (100 * most >= percent * (np.add.outer(n[left], n[right]) - most)) & (100 * np.minimum.outer(n[left], n[right]) >= percent * np.maximum.outer(n[left], n[right]))
        # Pairs of one component needn't be looked at; of pairs that two tasks have, one looks.
        ok &= (part[left][:, None] != part[right][None, :]) & (~out[right][None, :] | (sig[left][:, None] < sig[right][None, :]))
        if ok.any():
            others = [np.frombuffer(o, np.uint64) for o in pdf["others"]]
            for prefixes in ([np.asarray(p).astype(np.uint64) for p in pdf["posts"]], [o[: len(o) // 2] for o in others], [o[len(o) // 2 :] for o in others]):
                if ok.any():
                    ok &= _shares(prefixes, left, right)
        token = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
        root = {int(x): int(x) for x in part}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in np.argwhere(ok):
            a, b = int(left[i]), int(right[j])
            ra, rb = find(int(part[a])), find(int(part[b]))
            if ra == rb:
                continue
            both = len(np.intersect1d(token[a], token[b], assume_unique=True))
            if 100 * both >= percent * (n[a] + n[b] - both):
                root[ra] = rb
                found.append((sig[a], sig[b]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _star(posts: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """Step 4: the links between one class of each token's list and the others."""
    heads = posts.groupBy("token").agg(F.min(F.struct(F.xxhash64("sig").alias("h"), "sig", "n", "shared", "indexed")).alias("head")).select("token", "head.*").drop("h")
    x, y = heads.alias("x"), posts.alias("y")
    some = y.join(x.hint("merge"), F.expr(f"x.token = y.token and x.sig != y.sig and {_may_link(percent)}")).selectExpr(*_PAIR).distinct()
    return linked(some, able, percent)


def _rest(live: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """Step 5: the links between classes of different parts that lists of live have in common.

    Lists that have a class in common make a family. Its largest part is the main one; classes of other parts are
    dealt to pieces, and so are all; a task takes a piece of either.
    """
    heads = live.groupBy("token").agg(F.min("sig").alias("head"))
    family = components(live.select("token", "sig").join(heads.hint("merge"), "token").where("sig != head").select(F.col("sig").alias("a"), F.col("head").alias("b")))
    members = cut(live.select("sig", "part").distinct().join(family.select(F.col("node").alias("sig"), F.col("label").alias("family")).hint("merge"), "sig"))
    main = members.groupBy("family", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("family").agg(F.max(F.struct("c", "part")).alias("main"), F.sum("c").alias("c"))
    pieces = lambda c: F.ceil(c / PIECE).cast("int")
    main = main.select("family", F.col("main.part").alias("main"), pieces(F.col("c") - F.col("main.c")).alias("lefts"), pieces(F.col("c")).alias("rights")).where("lefts > 0")
    # A family may hold most classes: they are dealt by salt, and the family's one row goes to each.
    salted = members.withColumn("salt", F.pmod(F.xxhash64("sig", F.lit(7)), F.lit(SALTS)).cast("int"))
    main = main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = salted.join(main.hint("merge"), ["family", "salt"]).withColumn("outside", F.col("part") != F.col("main"))
    place = F.xxhash64("sig", F.lit(5))
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = rows.where("outside").select("family", "sig", "part", "outside", F.lit(0).alias("side"), F.pmod(place, F.col("lefts")).cast("int").alias("i"), up_to("rights").alias("j"))
    rights = rows.select("family", "sig", "part", "outside", F.lit(1).alias("side"), F.pmod(place, F.col("rights")).cast("int").alias("j"), up_to("lefts").alias("i"))
    dealt = lefts.unionByName(rights).join(able.select("sig", "n", "shared", "tokens", "others", "posts").hint("merge"), "sig")
    return dealt.groupBy("family", "i", "j").applyInPandas(_verify_blocks(percent), "a long, b long")


def links(able: DataFrame, percent: int) -> DataFrame | None:
    """(node, label) of the classes that links connect: steps 4 and 5. None without links."""
    posts = able.select(F.posexplode("posts").alias("place", "token"), "sig", "n", "shared", "indexed").withColumn("indexed", F.col("place") < F.col("indexed")).drop("place")
    # Lists of one post, or without an index post, have no pair.
    alive = posts.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.max("indexed").alias("i")).where("c > 1 and i").select("token")
    posts = cut(posts.join(alive.hint("merge"), "token"))
    found = cut(_star(posts, able, percent))
    if found.isEmpty():
        labels, parted = None, posts.withColumn("part", F.col("sig"))
    else:
        labels = components(found)
        parted = posts.join(labels.select(F.col("node").alias("sig"), "label").hint("merge"), "sig", "left").withColumn("part", F.coalesce("label", "sig")).drop("label")
    # A list within one component is done.
    open_ = parted.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("token")
    live = cut(parted.select("token", "sig", "part").join(open_.hint("merge"), "token"))
    if live.isEmpty():
        return labels
    more = cut(_rest(live, able, percent))
    drop(live, posts)
    return labels if more.isEmpty() else components(found.union(more))


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, class_id (equal sets have equal ones).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``width``-word
    shingles; component_id is the smallest doc_id that links lead to.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    dealt = docs.mapInArrow(_deal(parts, width), _BLOCK)
    met = dealt.repartitionById(parts, F.col("part")).mapInArrow(_meet_tokens(parts), _BLOCK)
    classes = cut(met.repartitionById(parts, F.col("part")).mapInArrow(_meet_classes(percent), _CLASS))
    rows = classes.where("kind = 1").select("doc_id", "sig", "n")
    joined = links(classes.where("kind = 0"), percent)

    # Step 6: classes, then components, get their smallest doc_id.
    least = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"))
    if joined is None:
        named = least.select("sig", F.col("first").alias("component_id"))
    else:
        least = least.join(joined.select(F.col("node").alias("sig"), "label").hint("merge"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        by_label = least.groupBy("label").agg(F.min("first").alias("component_id"))
        named = least.join(by_label.hint("merge"), "label").select("sig", "component_id")
    return rows.join(named.hint("merge"), "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("sig").alias("class_id"))


def keep_one_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, null ids last; of equal ids any one.

    Documents without words are linked with nothing and all stay, repeated ones too. Rows are told apart by a
    64-bit hash of doc_id and text, so that rows of one id but other text are judged by themselves.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))
    ids = keyed.groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("c"))
    parts = similar_components(keyed.select("key", "text"), width, percent, id_col="key").groupBy("doc_id").agg(F.min("component_id").alias("component"), F.max("n_shingles").alias("n"))
    members = parts.join(ids.hint("merge"), parts["doc_id"] == ids["key"]).select("component", F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "n", "c").alias("m"))
    kept = cut(members.groupBy("component").agg(F.min("m").alias("m")).select(F.col("m.key").alias("__key"), F.expr("m.n > 0 and m.c > 1").alias("__repeated")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn("__key", key).join(kept.hint("merge"), "__key")
    if kept.where("__repeated").isEmpty():
        return rows.select(columns)
    return rows.where("not __repeated").select(columns).union(rows.where("__repeated").dropDuplicates(["__key"]).select(columns))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


#: The same by brute force: all pairs of documents with a shingle in common, then components by recursion.
ORACLE = r"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh from w),
n as (select doc_id, len(sh)::bigint as n from s),
e as (select doc_id, hash(unnest(sh)) as h from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as common from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 90 * (a.n + b.n - common)),
g as (select x, y from l union select y, x from l),
r as (select doc_id as k, doc_id as c from n union select g.y as k, r.c from r join g on g.x = r.k)
select n.doc_id, n.n as n_shingles, min(r.c) as component_id from n join r on r.k = n.doc_id group by 1, 2
"""
