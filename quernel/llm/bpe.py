"""BPE encoding and decoding by per-prefix dynamic programming.

A byte-level BPE with ordered merges gives every prefix of a piece of text exactly one encoding, and
therefore one last token. For each prefix the vocabulary tokens that end there are read off a suffix
automaton of the vocabulary, longest first; a token is the last one if it is the whole prefix's first
token or if it may follow the last token of what stands before it (no merge would have crossed the
border: the compatibility test). Following the stored last tokens backwards gives the ids.

An encoder and what it remembers of pieces and pairs take some 200 MB of a worker at most; beyond that a worker
holds the batch that Spark sends and the strings of ``SLICE`` rows of it.

Input cases: null text counts as empty and gives no ids; very long texts and pieces take time and
memory in proportion to their length; repeated rows are encoded alike; extra columns are kept by
``encode_documents`` unless named ``ids``, in which case the new column replaces them; empty tables
give empty results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quernel.llm.common import release, ship, table, text_or_empty

#: The byte-level pre-tokenizer's pattern (a fixed value of the public format), letters spelt out by category.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+| ?\p{N}+| ?[^\s\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of text whose encodings a worker keeps at once, in each of two generations.
CACHE_PIECES = 350_000
#: Token pairs whose compatibility a worker keeps at once.
CACHE_PAIRS = 400_000
#: Rows whose texts are Python strings at once.
SLICE = 256


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class SuffixAutomaton:
    """Generalised suffix automaton of the tokens, by their ids; a token is the longest string of one state."""

    def __init__(self, tokens: dict[int, bytes]):
        self.go: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for token in tokens.values():
            last = 0
            for b in token:
                last = self._extend(last, b)
        # Clones may have taken over as a token's state: place each token by walking.
        ends: dict[int, int] = {}
        for k, token in tokens.items():
            state = 0
            for b in token:
                state = self.go[state][b]
            if self.length[state] == len(token):
                ends[state] = k
        leaf: dict[int, int] = {}
        self.go = [to or leaf for to in self.go]
        # For each state the tokens that end wherever its strings do, longest first, as (length, id). Pairs are shared, and all of it by states that end no token.
        self.ending: list[tuple] = [()] * len(self.go)
        for s in sorted(range(1, len(self.go)), key=self.length.__getitem__):
            rest = self.ending[self.link[s]]
            k = ends.get(s)
            self.ending[s] = rest if k is None else ((self.length[s], k), *rest)

    def _extend(self, last: int, b: int) -> int:
        go, link, length = self.go, self.link, self.length
        if b in go[last]:
            q = go[last][b]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, b, q)
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and b not in go[p]:
            go[p][b] = new
            p = link[p]
        if p != -1:
            q = go[p][b]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, b, q)
        return new

    def _clone(self, p: int, b: int, q: int) -> int:
        go, link, length = self.go, self.link, self.length
        new = len(go)
        go.append(dict(go[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and go[p].get(b) == q:
            go[p][b] = new
            p = link[p]
        return new


class Bpe:
    """Exact encoder and decoder of one byte-level BPE file."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_text = {i: s.encode() for s, i in self.special.items()}
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.split = regex.compile(PATTERN)
        self.by_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # Ranks: single bytes come before all merges; a merged token has the rank of the merge that makes it.
        self.made_by: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        rank = {i: -1 for i in self.bytes_of}
        for k, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            self.made_by[pair] = k
            if made not in parts:
                parts[made], rank[made] = pair, k
        self.parts, self.rank = parts, rank
        self.automaton = SuffixAutomaton({i: data for i, data in self.bytes_of.items() if i in parts or len(data) == 1})
        # Ids as decimals, for the lists of ids that are kept as text, and what these decode to.
        self.name = {i: str(i) for i in self.bytes_of | self.special_text}
        self.bytes_of_name = {name: self.special_text[i] if i in self.special_text else self.bytes_of[i] for i, name in self.name.items()}
        self.pairs: dict[int, bool] = {}
        # Pieces' ids joined by commas, in two generations: what is used again moves from the older to the younger.
        self.pieces: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def compatible(self, first: int, second: int) -> bool:
        """Whether merging the bytes of first and second together ends with just these two tokens.

        Both are undone merge by merge, the later merge first. Whenever two tokens then touch at the
        border and a merge of them comes before the merges undone so far, it would have been done
        first and the border would have vanished.
        """
        a, b, before, ok = first, second, len(self.made_by), True
        while True:
            merge = self.made_by.get((a, b))
            if merge is not None and merge < before:
                ok = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                before, a = ra, self.parts[a][1]
            else:  # of equal merges the one further left is done first, so the right one is undone first
                before, b = rb + 1, self.parts[b][0]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[first << 32 | second] = ok
        return ok

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        go, link, length, ending, pairs = self.automaton.go, self.automaton.link, self.automaton.length, self.automaton.ending, self.pairs
        last = [-1] * (len(data) + 1)
        state = size = end = 0
        for b in data:
            to = go[state].get(b)
            while to is None:
                state = link[state]
                size = length[state]
                to = go[state].get(b)
            state = to
            size += 1
            end += 1
            for n, t in ending[state]:
                if n > size:
                    continue
                before = last[end - n]
                if before >= 0:
                    ok = pairs.get(before << 32 | t)
                    if ok is None:
                        ok = self.compatible(before, t)
                    if not ok:
                        continue
                last[end] = t
                break
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def _piece(self, piece: str) -> str:
        got = self.older.get(piece)
        if got is None:
            got = ",".join([self.name[i] for i in self.encode_bytes(piece.encode("utf-8", "surrogatepass"))])
        if len(self.pieces) >= CACHE_PIECES:
            self.older, self.pieces = self.pieces, {}
        if len(piece) < 64:
            self.pieces[piece] = got
        return got

    def ids_text(self, text: str) -> str:
        """The ids of text in decimals, joined by commas."""
        out: list[str] = []
        for k, run in enumerate(self.by_special.split(text) if self.by_special else [text]):
            if k % 2:
                out.append(self.name[self.special[run]])
                continue
            pieces, known = self.split.findall(run), self.pieces
            got = [known.get(p) for p in pieces]
            if None in got:
                got = [g or known.get(p) or self._piece(p) for g, p in zip(got, pieces, strict=True)]
            out += got
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        ids = self.ids_text(text)
        return [int(i) for i in ids.split(",")] if ids else []

    def decoded_text(self, ids: str) -> bytes:
        """What ids in decimals, joined by commas, decode to, in UTF-8 as ``decode`` has it."""
        data = b"".join(map(self.bytes_of_name.__getitem__, ids.split(","))) if ids else b""
        return data.decode("utf-8", "replace").encode()

    def decode(self, ids) -> str:
        """As the tokenizers library decodes without skipping special tokens; broken UTF-8 becomes U+FFFD."""
        return b"".join(self.special_text[i] if i in self.special_text else self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_BUILT: dict[str, Bpe] = {}


def built(text: str) -> Bpe:
    """One encoder a worker process and tokenizer file."""
    key = hashlib.sha1(text.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Bpe(json.loads(text))
    return _BUILT[key]


def _broadcast(spark: SparkSession, path: str | None) -> Broadcast:
    """The tokenizer file's text (a few MB, whatever the corpus) for every executor."""
    with open(path or default_tokenizer_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def texts_of(column: pa.Array) -> Iterator[str]:
    """A column's texts, of which ``SLICE`` are Python strings at once."""
    for k in range(0, len(column), SLICE):
        yield from text_or_empty(column.slice(k, SLICE).to_pylist())


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with ``ids`` array<int>: each whole text's token ids. Narrow: no shuffle, a batch of rows at a time."""
    ship(docs.sparkSession)
    spec = _broadcast(docs.sparkSession, path)
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bpe = built(spec.value)
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            ids = pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with ``decoded`` string: each row's ids decoded. Null ids decode to an empty string."""
    ship(docs.sparkSession)
    spec = _broadcast(docs.sparkSession, path)
    docs = docs.drop("decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bpe = built(spec.value)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bpe.decode(r or []) for r in rows], pa.string())], names=[*batch.schema.names, "decoded"])

    return docs.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: what encode and decode give, as digests.

    Ids stay text, from which they are counted and decoded, so that long id lists need not leave the worker.
    """
    ship(docs.sparkSession)
    spec = _broadcast(docs.sparkSession, path)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bpe = built(spec.value)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for t in texts_of(batch.column(1)):
                got = bpe.ids_text(t)
                counts.append(got.count(",") + 1 if got else 0)
                ids.append(hashlib.sha256(got.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decoded_text(got)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return docs.select("doc_id", text_col).mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
