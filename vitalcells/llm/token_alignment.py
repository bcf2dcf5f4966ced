"""Alignment of two tokenizers' tokens by the bytes they cover.

The byte offsets where a token of both tokenizers ends cut a text into groups. What a byte range of a
text knows of them is a fragment: an open prefix (tokens up to its first common end), closed groups, an
open suffix (tokens after its last common end). Fragments of neighbouring ranges compose, the suffix of
one and the prefix of the next closing a group, and composition is associative, so a tree of Spark tasks
reduces the fragments of a very long document.

A long text is cut into blocks where neither tokenizer can join what stands on both sides: before a
single space between two visible characters. The byte-level tokenizer splits there before it merges
anything, and no piece of the other one holds a space mark after another character (this is read from
its vocabulary). Blocks are dealt over the tasks; text without such a place stays one block.

The same cuts part a block into units, mostly a word and the space before it. A unit has the same tokens
wherever it stands, and both tokenizers end with it, so the fragment of a text is composed of those of its
units, and a task tokenizes a unit once for as long as it remembers it.

A link is a pair of tokens that end together, so it is known in the unit of that end. Its count over the
corpus is looked up per bundle of documents, in which every distinct pair occurs once; the documents of a
bundle wait in a written table meanwhile, as numbers of units.

Defined results: texts that are null, empty, or not given back byte for byte by a tokenizer (space and
text) have no tokens, count nothing and have zeros, and an empty digest; special tokens' strings are
plain text; a text of any length is cut into blocks, its list of groups is one row again at the end;
repeated rows are documents of their own; a null doc_id is kept; ties of the highest count all count;
an empty table has an empty result; other columns are not read.
"""

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcells.llm.arrow import record_batch
from vitalcells.llm.scratch import Scratch

BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters after which a long text is cut at the next safe place.
BLOCK_CHARS = 1 << 16
#: Characters whose tokens are looked at together, and whose documents share one list of pairs.
BUNDLE_CHARS = 2 << 20
#: Characters handed to the byte-level tokenizer at a time.
ENCODE_CHARS = 1 << 12
#: Units that a task remembers.
MOST_UNITS = 300_000
#: Fragments composed by one task at a time.
FAN_IN = 32
ID_BITS = 20

# Written from the space on, which is looked for fast.
_SAFE_CUT = re.compile(r" (?<=[!-~\w] )(?=[!-~\w])")
_VISIBLE = re.compile(r"[!-~\w]")

DOC = ("struct<uid: long, doc_id: long, blocks: int, n_units: long, n_a: long, n_b: long, n_groups: long, "
       "n_links: long, groups_sha256: string>")
# A bundle is named by its first document and block. `units` holds the numbers of its documents' units,
# `unit_links` how many links each distinct unit has and then their places in `pairs`, all end to end
# and compressed.
BUNDLE = (f"uid long, block int, blocks int, ok boolean, docs array<{DOC}>, pairs array<long>, counts array<long>, "
          "units binary, unit_links binary, n_distinct int, n_places int, head binary, body binary, tail binary")
BUNDLE_KEY = ["uid", "block"]
SUMS = ("uid long, doc_id long, blocks int, n_a long, n_b long, n_groups long, n_links long, "
        "n_best long, count_sum long, groups_sha256 string")
RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


# Tokenizers: ids per text, and the bytes of each id.

def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the
    others for the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = _byte_alphabet()
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else b""
                      for name in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, at = [], 0
        while at < len(texts):  # the library's results are large, so few texts at a time
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= ENCODE_CHARS):
                size += len(texts[end])
                end += 1
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return ids


class PieceTokens:
    """The library puts a space before a text, so texts come without the one they begin with."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            byte = self.processor.is_byte(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if byte
                              else piece.replace("▁", " ").encode())
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"{piece!r} joins words, so texts cannot be cut at spaces")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode([t[1:] for t in texts], num_threads=1)


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        if max(len(self.a.bytes), len(self.b.bytes)) > 1 << ID_BITS:
            raise ValueError("too many token ids")
        # Texts of an id with what follows it: a comma in a group, or the end of its list.
        names_a = [b"%d" % i for i in range(len(self.a.bytes))]
        names_b = [b"%d" % i for i in range(len(self.b.bytes))]
        self.texts = ([n + b"," for n in names_a] + [n + b"|" for n in names_a]
                      + [n + b"," for n in names_b] + [n + b";" for n in names_b])
        self.last_a, self.first_b = len(names_a), 2 * len(names_a)
        self.last_b = self.first_b + len(names_b)


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


# Fragments.

@dataclass(frozen=True)
class Open:
    """Ids of both tokenizers, in order, that are in no closed group yet."""

    a: tuple[int, ...] = ()
    b: tuple[int, ...] = ()

    def __add__(self, other: "Open") -> "Open":
        return Open(self.a + other.a, self.b + other.b)

    def group(self) -> bytes:
        return b",".join(b"%d" % i for i in self.a) + b"|" + b",".join(b"%d" % i for i in self.b) + b";"

    def dump(self) -> bytes:
        return np.array([len(self.a), *self.a, *self.b], np.int64).tobytes()

    @staticmethod
    def load(raw: bytes) -> "Open":
        n, *ids = np.frombuffer(raw, np.int64).tolist()
        return Open(tuple(ids[:n]), tuple(ids[n:]))


@dataclass(frozen=True)
class Fragment:
    """What a byte range knows of the groups: `head` ends with its first common end, `body` holds the
    groups closed after it, `tail` follows the last one. Without a common end all is head and body is
    None."""

    head: Open
    body: bytes | None = None
    tail: Open = Open()

    def compose(self, right: "Fragment") -> "Fragment":
        if self.body is None:
            return Fragment(self.head + right.head, right.body, right.tail)
        if right.body is None:
            return Fragment(self.head, self.body, self.tail + right.head)
        return Fragment(self.head, self.body + (self.tail + right.head).group() + right.body, right.tail)

    def groups(self) -> bytes:
        """All groups of a whole text."""
        if self.body is None or self.tail != Open():
            raise ValueError("a whole text ends with a common end")
        return self.head.group() + self.body


def fragment(ids_a, ends_a, ids_b, ends_b, low: int, high: int) -> Fragment:
    """The fragment of a byte range: tokens belong to the range in which they end."""
    a = [(e, i) for i, e in zip(ids_a, ends_a) if low < e <= high]
    b = [(e, i) for i, e in zip(ids_b, ends_b) if low < e <= high]
    common = sorted({e for e, _ in a} & {e for e, _ in b})
    edges = [low, *common, high]

    def between(lo, hi):
        return Open(tuple(i for e, i in a if lo < e <= hi), tuple(i for e, i in b if lo < e <= hi))

    parts = [between(lo, hi) for lo, hi in zip(edges, edges[1:])]
    if not common:
        return Fragment(parts[0])
    return Fragment(parts[0], b"".join(p.group() for p in parts[1:-1]), parts[-1])


def compose_all(fragments: list[Fragment]) -> Fragment:
    whole = fragments[0]
    for right in fragments[1:]:
        whole = whole.compose(right)
    return whole


# Tasks.

def blocks_of(text: str, limit: int) -> list[str]:
    """Space and text, cut before spaces that no token crosses."""
    text = " " + text
    blocks, start = [], 0
    while len(text) - start > limit:
        cut = _SAFE_CUT.search(text, start + limit)
        if cut is None:
            break
        blocks.append(text[start:cut.start()])
        start = cut.start()
    return [*blocks, text[start:]]


def _block_rows(limit: int):
    names = ["uid", "doc_id", "block", "blocks", "text"]

    def run(batches):
        for batch in batches:
            uids, ids, texts = (batch.column(c) for c in ("uid", "doc_id", "text"))
            for i in range(batch.num_rows):
                blocks = blocks_of(texts[i].as_py(), limit)
                n = len(blocks)
                yield record_batch(names, pa.array([uids[i].as_py()] * n, pa.int64()),
                                   pa.array([ids[i].as_py()] * n, pa.int64()),
                                   pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()),
                                   pa.array(blocks, pa.string()))

    return run


def _tokens(tokens, texts: list[str], raw: list[bytes]):
    """Ids of all texts, and whether their bytes come back."""
    lists = tokens.encode(texts)
    return lists, [b"".join(map(tokens.bytes.__getitem__, x)) == r for x, r in zip(lists, raw)]


def _ends(tokens, lists) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.array(x, np.int64) for x in lists])
    sizes = np.array([len(b) for b in tokens.bytes], np.int64)
    return ids, np.cumsum(sizes[ids])


@dataclass
class Units:
    """Distinct units: tokens, groups as text, whether their bytes come back, and their links end to end."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    texts: list[bytes]
    links: np.ndarray


def _align(tools: Aligner, lists_a, lists_b, limits: np.ndarray):
    """Tokens, group texts and links up to each limit, in tokens that lie end to end; limits are ends of
    both kinds."""
    ids_a, ends_a = _ends(tools.a, lists_a)
    ids_b, ends_b = _ends(tools.b, lists_b)
    at = np.searchsorted(ends_b, ends_a)
    common_a = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a
    common_b = np.zeros(len(ends_b), bool)
    common_b[at[common_a]] = True
    links = (ids_a[common_a] << ID_BITS) | ids_b[common_b]
    group_a = np.cumsum(common_a) - common_a
    group_b = np.cumsum(common_b) - common_b
    # A group's a tokens, then its b tokens: each moves back by the other kind's tokens before it.
    through_a = np.flatnonzero(common_a) + 1
    through_b = np.append(0, np.flatnonzero(common_b) + 1)
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + through_b[group_a]] = ids_a + np.where(common_a, tools.last_a, 0)
    codes[np.arange(len(ids_b)) + through_a[group_b]] = ids_b + np.where(common_b, tools.last_b, tools.first_b)
    n_a = np.searchsorted(ends_a, limits, "right")
    n_b = np.searchsorted(ends_b, limits, "right")
    edges = np.append(0, n_a + n_b).tolist()
    words = list(map(tools.texts.__getitem__, codes.tolist()))
    texts = [b"".join(words[s:e]) for s, e in zip(edges, edges[1:])]
    n_links = np.searchsorted(ends_a[common_a], limits, "right")
    return *(np.diff(n, prepend=0) for n in (n_a, n_b, n_links)), texts, links


def _runs_of_units(parts: list[str]) -> list[list[int]]:
    """Units that may stand behind one another in a text to tokenize: those that begin and end with a
    visible character, some at a time; every other one alone."""
    runs, run, size = [], [], 0
    for i, part in enumerate(parts):
        if not (_VISIBLE.match(part[0]) and _VISIBLE.match(part[-1])):
            runs.append([i])
            continue
        run.append(i)
        size += len(part) + 1
        if size >= ENCODE_CHARS:
            runs.append(run)
            run, size = [], 0
    return [*runs, run] if run else runs


def align_units(tools: Aligner, parts: list[str]) -> Units:
    """Units, given without the space before them."""
    n = len(parts)
    out = Units(np.zeros(n, bool), *(np.zeros(n, np.int64) for _ in range(3)), [b""] * n, np.zeros(0, np.int64))
    found, order = [], []
    waiting = _runs_of_units(parts)
    while waiting:
        texts = [" " + " ".join([parts[i] for i in run]) for run in waiting]
        raw = [t.encode() for t in texts]
        lists_a, back_a = _tokens(tools.a, texts, raw)
        lists_b, back_b = _tokens(tools.b, texts, raw)
        good = [k for k in range(len(waiting)) if back_a[k] and back_b[k]]
        if good:
            units = [i for k in good for i in waiting[k]]
            limits = np.cumsum([1 + len(parts[i].encode()) for i in units])
            n_a, n_b, n_links, texts, links = _align(
                tools, [lists_a[k] for k in good], [lists_b[k] for k in good], limits)
            out.ok[units], out.n_a[units], out.n_b[units], out.n_links[units] = True, n_a, n_b, n_links
            for i, text in zip(units, texts):
                out.texts[i] = text
            found.append(links)
            order += units
        # Where a run is not given back, its units are tried alone.
        waiting = [[i] for k in set(range(len(waiting))) - set(good) if len(waiting[k]) > 1 for i in waiting[k]]
    if found:
        # Links lie by the order of work; put them in the order of units.
        sizes = out.n_links[order]
        starts = np.zeros(n, np.int64)
        starts[order] = np.cumsum(sizes) - sizes
        begin = np.repeat(starts, out.n_links)
        step = np.arange(len(begin)) - np.repeat(np.cumsum(out.n_links) - out.n_links, out.n_links)
        out.links = np.concatenate(found)[begin + step]
    return out


class UnitTable:
    """Units met by a task, numbered in order; emptied when it has grown to MOST_UNITS."""

    def __init__(self, tools: Aligner):
        self.tools = tools
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.units = align_units(self.tools, [])

    def numbers(self, blocks: list[str]) -> list[np.ndarray]:
        """Numbers of the units of some blocks; those met for the first time are tokenized."""
        if len(self.number) > MOST_UNITS:
            self._clear()
        known = len(self.number)
        found = [np.array([self.number.setdefault(part, len(self.number)) for part in _SAFE_CUT.split(text[1:])]
                          if text else [], np.int64) for text in blocks]
        fresh = align_units(self.tools, list(islice(self.number, known, None)))
        old = self.units
        self.units = Units(*(np.concatenate([getattr(old, f), getattr(fresh, f)])
                             for f in ("ok", "n_a", "n_b", "n_links")), old.texts + fresh.texts,
                           np.concatenate([old.links, fresh.links]))
        return found

    def links_of(self, units: np.ndarray) -> np.ndarray:
        """Links of some units, end to end."""
        sizes = self.units.n_links[units]
        first = (np.cumsum(self.units.n_links) - self.units.n_links)[units]
        return self.units.links[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _sums_by(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of values."""
    total = np.append(0, np.cumsum(values))
    edges = np.append(0, np.cumsum(sizes))
    return total[edges[1:]] - total[edges[:-1]]


def _bundles(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Rows of about `limit` characters; a block of a long text is a bundle of its own."""
    held, size = [], 0
    for batch in batches:
        columns = [batch.column(c) for c in ("uid", "doc_id", "block", "blocks", "text")]
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            if row[3] > 1:
                yield [row]
                continue
            held.append(row)
            size += len(row[4])
            if size >= limit or len(held) >= 20_000:
                yield held
                held, size = [], 0
    if held:
        yield held


def _digest(groups: bytes) -> str:
    """The last group has no mark behind it."""
    return hashlib.sha256(groups[:-1]).hexdigest()


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.astype(np.uint32).tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * size, "zstd", asbytes=True), np.uint32).astype(np.int64)


def _bundle_rows(byte_path: str, piece_path: str, limit: int):
    schema = pa.schema([
        ("uid", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("ok", pa.bool_()),
        ("docs", pa.list_(pa.struct([
            ("uid", pa.int64()), ("doc_id", pa.int64()), ("blocks", pa.int32()), ("n_units", pa.int64()),
            ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
            ("groups_sha256", pa.string())]))),
        ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("units", pa.binary()),
        ("unit_links", pa.binary()), ("n_distinct", pa.int32()), ("n_places", pa.int32()), ("head", pa.binary()), ("body", pa.binary()), ("tail", pa.binary())])

    def row_of(table: UnitTable, rows: list[tuple]) -> dict:
        of_doc = table.numbers([r[4] for r in rows])
        units = table.units
        docs = [dict(uid=uid, doc_id=doc_id, blocks=blocks, n_units=0, n_a=0, n_b=0, n_groups=0, n_links=0,
                     groups_sha256="") for uid, doc_id, _, blocks, _ in rows]
        uid, _, block, blocks, _ = rows[0]
        good = [i for i, u in enumerate(of_doc) if len(u) and units.ok[u].all()]
        out = dict(uid=uid, block=block, blocks=blocks, ok=len(good) == len(rows), docs=docs, pairs=[], counts=[],
                   units=b"", unit_links=b"", n_distinct=0, n_places=0, head=None, body=None, tail=None)
        if not good:
            return out
        sizes = [len(of_doc[i]) for i in good]
        flat = np.concatenate([of_doc[i] for i in good])
        sums = [_sums_by(sizes, n[flat]).tolist() for n in (units.n_a, units.n_b, units.n_links)]
        used, own, times = np.unique(flat, return_inverse=True, return_counts=True)
        pairs, place = np.unique(table.links_of(used), return_inverse=True)
        counts = np.bincount(place, np.repeat(times, units.n_links[used]), len(pairs)).astype(np.int64)
        out.update(pairs=pairs, counts=counts, units=_packed(own), n_distinct=len(used), n_places=len(place),
                   unit_links=_packed(np.concatenate([units.n_links[used], place])))
        for i, size, n_a, n_b, n_links in zip(good, sizes, *sums):
            docs[i].update(n_units=size, n_a=n_a, n_b=n_b, n_groups=n_links, n_links=n_links)
            groups = b"".join(map(units.texts.__getitem__, of_doc[i].tolist()))
            if blocks == 1:
                docs[i]["groups_sha256"] = _digest(groups)
            else:
                whole = _as_fragment(groups)
                out.update(head=whole.head.dump(), body=whole.body, tail=whole.tail.dump())
        return out

    def run(batches):
        table = UnitTable(aligner(byte_path, piece_path))
        for rows in _bundles(batches, limit):
            yield pa.RecordBatch.from_pylist([row_of(table, rows)], schema)

    return run


def _as_fragment(groups: bytes) -> Fragment:
    """Closed groups as a fragment: the first one is its open prefix, as its range knows no more."""
    first, body = groups.split(b";", 1)
    a, b = first.split(b"|")
    return Fragment(Open(tuple(map(int, a.split(b","))), tuple(map(int, b.split(b",")))), body)


FRAGMENT = "uid long, place long, head binary, body binary, tail binary"


def _compose_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The fragments of one node of a document's tree as one, in the order of their places."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    whole = compose_all([Fragment(Open.load(r["head"]), r["body"], Open.load(r["tail"])) for r in rows])
    return pa.table({"uid": [key[0].as_py()], "place": pa.array([key[1].as_py()], pa.int64()),
                     "head": [whole.head.dump()], "body": pa.array([whole.body], pa.binary()),
                     "tail": [whole.tail.dump()]})


def long_digests(fragments: DataFrame, most: int, scratch: Scratch, fan_in: int = FAN_IN) -> DataFrame:
    """uid and digest of the groups of each long text, composed as a tree of `fan_in` branches."""
    while most > 1:
        fragments = scratch.write(
            fragments.withColumn("node", F.floor(F.col("place") / fan_in)).groupBy("uid", "node")
            .applyInArrow(_compose_rows, FRAGMENT), "fragments")
        most = -(-most // fan_in)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            whole = [Fragment(Open.load(r["head"]), r["body"], Open.load(r["tail"])).groups() for r in rows]
            yield record_batch(["uid", "long_sha256"], batch.column("uid"),
                               pa.array([_digest(w) for w in whole], pa.string()))

    return fragments.mapInArrow(run, "uid long, long_sha256 string")


SUMS_SCHEMA = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("blocks", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
    ("groups_sha256", pa.string())])


def _sum_rows(bundles: pa.Table, found: pa.Table) -> pa.Table:
    """Per document of a bundle: its links whose count is the highest of their id, and all counts."""
    bundles = bundles.combine_chunks()
    docs = bundles["docs"].chunk(0).flatten()
    uid, doc_id, blocks, n_units, n_a, n_b, n_groups, n_links, digest = docs.flatten()
    of_docs = n_units.to_numpy()
    best = count = np.zeros(len(docs), np.int64)
    if of_docs.sum():
        flat = _unpacked(bundles["units"][0].as_py(), int(of_docs.sum()))
        distinct, places = bundles["n_distinct"][0].as_py(), bundles["n_places"][0].as_py()
        unit_links = _unpacked(bundles["unit_links"][0].as_py(), distinct + places)
        place = found["place"].to_numpy()

        def sums(column):
            of_pair = np.zeros(len(found), np.int64)
            of_pair[place] = found[column].to_numpy()
            return _sums_by(of_docs, _sums_by(unit_links[:distinct], of_pair[unit_links[distinct:]])[flat])

        best, count = sums("best"), sums("count")
    return pa.table([uid, doc_id, blocks, n_a, n_b, n_groups, n_links, pa.array(best, pa.int64()),
                     pa.array(count, pa.int64()), digest], schema=SUMS_SCHEMA)


def pair_counts(bundles: DataFrame) -> DataFrame:
    """Corpus-wide count of each linked pair of ids, and whether it is the highest of its b id."""
    counts = (bundles.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
              .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count")))
    b = F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b")
    highest = counts.groupBy(b).agg(F.max("count").alias("highest"))
    return (counts.withColumn("b", b).join(highest, "b")
            .select("pair", "count", (F.col("count") == F.col("highest")).alias("best")))


def align_documents(docs: DataFrame, byte_path: str = BYTE_TOKENIZER, piece_path: str = PIECE_TOKENIZER,
                    block_chars: int = BLOCK_CHARS, bundle_chars: int = BUNDLE_CHARS,
                    fan_in: int = FAN_IN) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    scratch = Scratch(docs.sparkSession, "alignment")
    texts = docs.select(F.monotonically_increasing_id().alias("uid"),
                        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    one = F.lit(1).cast("int")
    short = texts.where(F.length("text") < block_chars).select(
        "uid", "doc_id", (one - 1).alias("block"), one.alias("blocks"),
        F.when(F.col("text") == "", "").otherwise(F.concat(F.lit(" "), "text")).alias("text"))
    cut = (texts.where(F.length("text") >= block_chars)
           .mapInArrow(_block_rows(block_chars), "uid long, doc_id long, block int, blocks int, text string"))
    # Only the blocks of long texts move, so that one document's blocks are many tasks' work.
    work = short.unionByName(cut.repartition("uid", "block"))
    bundles = scratch.write(work.mapInArrow(_bundle_rows(byte_path, piece_path, bundle_chars), BUNDLE), "bundles")

    long = bundles.where("blocks > 1")
    spoilt = long.where("not ok").select("uid").distinct()
    whole = long.join(spoilt, "uid", "left_anti")
    kept = [*BUNDLE_KEY, "docs", "pairs", "counts", "units", "unit_links", "n_distinct", "n_places"]
    counted = bundles.where("blocks = 1").select(kept).unionByName(whole.select(kept))
    pairs = scratch.write(pair_counts(counted), "pairs")
    found = (counted.select(F.col("uid").alias("of_uid"), F.col("block").alias("of_block"),
                            F.posexplode("pairs").alias("place", "pair")).join(pairs, "pair")
             .select("of_uid", "of_block", "place", "count", F.col("best").cast("long").alias("best")))
    sums = scratch.write(
        counted.select(*BUNDLE_KEY, "docs", "units", "unit_links", "n_distinct", "n_places").groupBy(*BUNDLE_KEY)
        .cogroup(found.groupBy("of_uid", "of_block"))
        .applyInArrow(_sum_rows, SUMS), "sums")
    return (sums.where("blocks = 1").select(RESULT)
            .unionByName(_long_results(long, whole, sums.where("blocks > 1"), scratch, fan_in)))


def _long_results(long: DataFrame, whole: DataFrame, sums: DataFrame, scratch: Scratch,
                  fan_in: int) -> DataFrame:
    """Sums over the blocks of each long text; zeros where one of its blocks is not given back."""
    most = long.agg(F.max("blocks")).first()[0] or 0
    fragments = whole.select("uid", F.col("block").cast("long").alias("place"), "head", "body", "tail")
    digests = long_digests(fragments, most, scratch, fan_in)
    numbers = RESULT[1:-1]
    totals = sums.groupBy("uid").agg(*[F.sum(c).alias(c) for c in numbers])
    ids = long.where("block = 0").select("uid", F.element_at("docs", 1)["doc_id"].alias("doc_id"))
    return ids.join(totals, "uid", "left").join(digests, "uid", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("long_sha256", F.lit("")).alias("groups_sha256"))
