"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut at word starts, which no piece crosses; a cut's symbols are merged by an agenda of adjacent pairs, the
best score first and the leftmost among equals. Many short cuts are merged together: the agenda of each is a row of pair
ranks, of which the first least one is taken in each step; a long cut has its agenda in a heap. What has been encoded once
is kept for the next time, in a cache of bounded size; and each cut that is new to a worker, and a whole text of each
batch, can be checked against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_LIMIT, as_bytes

SPACE = "▁"
_SPACE = SPACE.encode()
#: Cuts in each of the two generations that a worker remembers.
CACHE_LIMIT = 300_000
#: Cuts of under 4 times as many symbols are merged together, longer ones one by one.
SCAN_LIMIT = 12


class Pairs:
    """Which id two adjacent ids merge to: a hash table in arrays, searched for many pairs at once."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.bits = max(4, (8 * len(merges)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        for a, b, i in merges:
            key = a << 32 | b
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.values[at] = key, i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids; -1 where a pair merges to nothing."""
        keys = np.where((a >= 0) & (b >= 0), a << 32 | b, -2)
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.nonzero((there >= 0) & (there != keys) & (keys >= 0))
        while len(left[0]):
            at[left] = (at[left] + 1) % len(self.keys)
            there = self.keys[at[left]]
            out[left] = np.where(there == keys[left], self.values[at[left]], -1)
            on = (there >= 0) & (there != keys[left])
            left = tuple(x[on] for x in left)
        return out


class Model:
    """A merge-type vocabulary with identity normalization: pieces, scores and how they are joined."""

    def __init__(self, proto: bytes, check: bool = False):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = p.vocab_size()
        pieces = [p.id_to_piece(i) for i in range(n)]
        special = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) for i in range(n)]
        byte = [p.is_byte(i) for i in range(n)]
        self.library, self.check = p, check
        self.bos, self.eos, self.unknown = p.bos_id(), p.eos_id(), p.unk_id()
        self.ids = {s: i for i, s in enumerate(pieces) if not special[i] and not byte[i]}
        self.cost = {s: -p.get_score(i) for s, i in self.ids.items()}  # a merge makes any piece, the least cost first
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise ValueError("ids are kept as little-endian 32-bit integers")
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in s.lstrip(SPACE) for s in self.ids):
            raise ValueError("a piece goes on after a word start; such vocabularies are not supported")
        if not all(byte[i] for i in self.bytes):
            raise ValueError("the vocabulary has no byte pieces")
        probe = "  ﬁ ½\tx Å "
        if p.decode(p.encode(probe)) != probe:
            raise ValueError("the vocabulary normalizes text; only identity normalization is supported")
        pairs = {a + b for s in self.ids for a, b in zip(s, s[1:])}
        after_letter = {b for a, b in pairs if a.isascii() and a.isalpha() or "\u00c0" <= a <= "\u024f"}
        closing = re.escape("".join(c for c in ".,;:!?" if c not in after_letter).encode())
        alone = rb"\n|" if not any("\n" in x for x in pairs) else b""
        letters = rb" *+(?:[A-Za-z]|[\xc3-\xc9][\x80-\xbf])++(?=[%b])|" % closing if closing else b""
        #: No piece reaches across a cut: cuts are before spaces, around line ends, and between a letter and a mark.
        self.cuts = re.compile(alone + letters + (rb" *+[^ \n]++| ++" if alone else rb" *+[^ ]++| ++")).findall
        self.surface = [
            b"" if p.is_control(i) or p.is_unused(i) else b" \xe2\x81\x87 " if p.is_unknown(i) else bytes([int(s[3:5], 16)]) if byte[i] else s.replace(SPACE, " ").encode()
            for i, s in enumerate(pieces)
        ]
        #: What stands before a cut where the library encodes it alone: something that no piece goes on after.
        self.before = "\n" if alone else "\u0001"
        self.before_ids = p.encode(self.before)
        self.is_byte = byte
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        chars = [(ord(s), i) for s, i in self.ids.items() if len(s) == 1]
        self.of_point = np.full(max(c for c, _ in chars) + 1, -1, np.int64)
        for c, i in chars:
            self.of_point[c] = i
        self.pairs = Pairs([(self.ids[s[:k]], self.ids[s[k:]], i) for s, i in self.ids.items() for k in range(1, len(s)) if s[:k] in self.ids and s[k:] in self.ids])
        order = np.unique([self.cost.get(s, np.inf) for s in pieces], return_inverse=True)[1]
        #: By id: the rank of a piece's cost; the last entry, at -1, is for no piece.
        self.none = int(order.max()) + 1
        self.rank = np.append(order, self.none).astype(np.int32)

    # encoding

    def merge(self, cut: str) -> list[str]:
        """The pieces of a cut, by an agenda of its adjacent pairs."""
        symbols = list(cut)
        cost, n = self.cost.get, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def add(i: int, j: int) -> None:
            if i >= 0 and j < n and (c := cost(pair := symbols[i] + symbols[j])) is not None:
                heapq.heappush(agenda, (c, i, j, pair))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != pair or after[i] != j:
                continue  # one of them has been merged since
            symbols[i], symbols[j] = pair, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            add(before[i], i)
            add(i, after[i])
        return [s for s in symbols if s]

    def merge_all(self, cuts: list[str]) -> list[list[int]]:
        """The ids of many short cuts: in each step, every cut merges the first pair of its own agenda.

        The agendas are the rows of a matrix of pair costs; -1 stands for a symbol that is no piece, and ends a row.
        """
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        width = int(lengths.max())
        points = np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32).astype(np.int64)
        inside = np.arange(width)[None, :] < lengths[:, None]
        symbols = np.full(inside.shape, -1, np.int64)
        symbols[inside] = np.where(points < len(self.of_point), self.of_point[np.minimum(points, len(self.of_point) - 1)], -1)
        unknown = np.full(inside.shape, -1, np.int64)
        unknown[inside] = points
        pair = self.pairs.find(symbols[:, :-1], symbols[:, 1:])
        cost = self.rank[pair]
        out, rows, columns = np.full(len(cuts), None, object), np.arange(len(cuts)), np.arange(width)

        def done(which: np.ndarray) -> None:
            kept = unknown[which] >= 0
            for r, ids, points, n in zip(rows[which].tolist(), symbols[which].tolist(), unknown[which].tolist(), kept.sum(1).tolist(), strict=True):
                ids = ids[:n]
                out[r] = ids if -1 not in ids else [x for i, p in zip(ids, points) for x in ([i] if i >= 0 else [self.bytes[b] for b in chr(p).encode()])]

        while len(rows):
            if width < 2:
                done(np.ones(len(rows), bool))
                break
            best = cost.argmin(1)
            at = np.arange(len(rows))
            ended = cost[at, best] == self.none
            if ended.any():
                done(ended)
                go = ~ended
                rows, symbols, unknown, pair, cost, best = rows[go], symbols[go], unknown[go], pair[go], cost[go], best[go]
                at = np.arange(len(rows))
                if not len(rows):
                    break
            symbols[at, best] = pair[at, best]
            width -= 1
            beyond = columns[None, :width] > best[:, None]
            symbols = np.where(beyond, symbols[:, 1:], symbols[:, :-1])
            unknown = np.where(beyond, unknown[:, 1:], unknown[:, :-1])
            if width < 2:
                continue
            skip = columns[None, : width - 1] >= best[:, None]
            pair = np.where(skip, pair[:, 1:], pair[:, :-1])
            cost = np.where(skip, cost[:, 1:], cost[:, :-1])
            for k in (best - 1, best):
                ok = np.flatnonzero((k >= 0) & (k < width - 1))
                found = self.pairs.find(symbols[ok, k[ok]], symbols[ok, k[ok] + 1])
                pair[ok, k[ok]], cost[ok, k[ok]] = found, self.rank[found]
        return out.tolist()

    def cut_ids(self, cut: str) -> list[int]:
        return [x for s in self.merge(cut) for x in ([self.ids[s]] if s in self.ids else [self.bytes[b] for b in s.encode()])]

    def learn(self, cuts: list[bytes]) -> None:
        """Adds cuts that are not known: their ids as little-endian 32-bit integers."""
        texts = [c.decode().replace(" ", SPACE) for c in cuts]
        ids: dict[bytes, list[int]] = {}
        by_size: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            by_size.setdefault(min((len(t) + 3) // 4, SCAN_LIMIT), []).append(k)
        for size, group in by_size.items():
            named = [texts[k] for k in group]
            ids.update(zip((cuts[k] for k in group), map(self.cut_ids, named) if size == SCAN_LIMIT else self.merge_all(named), strict=True))
        if self.check:
            for cut, there in zip(cuts, self.library.encode([self.before + c.decode() for c in cuts], num_threads=1), strict=True):
                if there != self.before_ids + ids[cut]:
                    raise ValueError(f"the library encodes {cut!r} otherwise")
        self.known.update((c, array("I", x).tobytes()) for c, x in ids.items())

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts, without begin and end, as little-endian 32-bit integers."""
        split = [self.cuts(b" " + t.replace(_SPACE, b" ")) if t else [] for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHE_LIMIT:
            self.known, self.older = {}, self.known
            new = set().union(*split)
        if new:
            old = {c: self.older[c] for c in new if c in self.older}
            self.known.update(old)
            if len(new) > len(old):
                self.learn([c for c in new if c not in old])
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def check_text(self, raw: bytes, ids: list[int]) -> None:
        """ValueError if the library encodes a whole text otherwise."""
        if self.library.encode(raw.decode()) != ids:
            raise ValueError(f"the library encodes otherwise: {raw[:200]!r}")

    def encode(self, text: str, ends: bool = True) -> list[int]:
        ids = array("I", self.encode_batch([text.encode()])[0]).tolist()
        return [self.bos, *ids, self.eos] if ends else ids

    # decoding

    def decode(self, ids: list[int]) -> str:
        """Any ids: byte pieces that are no UTF-8 become replacement characters, one a byte; one leading space goes."""
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            k = 0
            while k < len(run):
                for n in (4, 3, 2, 1):
                    try:
                        if len(s := bytes(run[k : k + n]).decode()) == 1:
                            break
                    except UnicodeDecodeError:
                        s = ""
                out.append(s if len(s) == 1 else "�")
                k += len(s.encode()) if len(s) == 1 else 1
            run.clear()

        first = True
        for i in ids:
            if not 0 <= i < len(self.surface):
                raise ValueError(f"no piece has the id {i}")
            if self.is_byte[i]:
                run += self.surface[i]
                first = False
                continue
            flush()
            s = self.surface[i].decode()
            if first and s:
                s = s[1:] if s[0] == " " and i != self.unknown else s
                first = False
            out.append(s)
        flush()
        return "".join(out)


_models: dict[tuple[str, bool], Model] = {}


def model(proto: bytes, check: bool = False) -> Model:
    """A worker's model; it is read once."""
    key = (hashlib.sha256(proto).hexdigest(), check)
    if key not in _models:
        _models[key] = Model(proto, check)
    return _models[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        proto = f.read(BROADCAST_LIMIT + 1)
    if len(proto) > BROADCAST_LIMIT:
        raise ValueError(f"{path} is larger than {BROADCAST_LIMIT} bytes")
    return proto


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, check: bool = True) -> DataFrame:
    """For each row: id_col, n_tokens (with begin and end), ids_sha256, decoded_sha256; with texts, ids and decoded too.

    path: a vocabulary's file on the driver, from which it is sent to the executors (at most 64 MB). All ids are decoded by the
    sentencepiece library's decode(ids). check: each cut that is new to a worker is also encoded by the library, and of each 512 rows one
    whole text; a difference is an error. Null and empty texts have the begin and end ids only, and decode to the empty text. Null ids and repeated rows are like any other
    row; a text's length is bound by its row only; an empty table gives an empty result; other columns are not read.
    """
    proto = docs.sparkSession.sparkContext.broadcast(read_model(path))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(proto.value, check)
        bos, eos = (np.array([i], "<u4").tobytes() for i in (m.bos, m.eos))
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                n, digest, decoded, id_lists, out_texts = [], [], [], [], []
                texts_ = [raw or b"" for raw in as_bytes(batch.column(1))]
                for raw, ids in zip(texts_, m.encode_batch(texts_), strict=True):
                    inner = array("I", ids).tolist()
                    if check and not n:
                        m.check_text(raw, inner)
                    back, ids = m.library.decode([m.bos, *inner, m.eos]).encode(), bos + ids + eos
                    n.append(len(ids) // 4)
                    digest.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    if texts:
                        id_lists.append(np.frombuffer(ids, "<u4").astype(np.int64))
                        out_texts.append(back.decode())
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if texts:
                    columns += [pa.array(id_lists, pa.list_(pa.int64())), pa.array(out_texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * texts
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
