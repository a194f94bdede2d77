"""SentencePiece models on the tokenizers library: encoding and decoding of whole texts, checked against the original.

The model's protocol buffer is parsed here (pieces with scores and types, trainer and normaliser settings) and rebuilt as a
tokenizer: the normaliser (character map, spaces to the metaspace marker, marker before the text), unigram scores or merges
ranked by score, byte fallback, and the decoder that reverses them.

The ids returned are the rebuilt tokenizer's. Every whole text is encoded by the sentencepiece library as well, and ``parity`` tells that all ids
agree (merges of equal score, as in long runs of spaces, may be taken in another order). ``round_trip`` tells that the ids decode to the text.

Where no piece holds the marker after another character (which is checked) and the normaliser drops and maps nothing, pieces never cross the start of a
word, so the rebuilt tokenizer needs to see only words that a worker hasn't seen yet; they are encoded in one multithreaded batch for each slice of
about ``SLICE`` bytes of texts. Words are told apart by their bytes. Texts that hold the marker itself, and all texts under other models, are encoded whole.

Model bytes are read on the driver and broadcast (a file of fixed size); no file is needed on executors. There is no
shuffle; a worker's memory is bounded by its batch, the ids of a slice and a cache of twice ``CACHE`` words.

Nulls and edges: null text gives null ids, 0 tokens, and true for both checks, as nothing is to be encoded; empty text gives no ids. Normalisers
that drop or change characters make ``round_trip`` false where they do. Repeated rows are encoded one by one. Extra columns are kept by ``encode``
if asked for; columns named like its results are replaced.
"""

from __future__ import annotations

import gc
import itertools
import os
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terrane.llm import textvec as tv
from terrane.llm.common import arrow_rows, give_back, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 200_000
THREADS = 2
SLICE = 4 << 20
TOGETHER = 64
# Fixed values of the public model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[i] & 127) << shift
        shift += 7
        i += 1
        if data[i - 1] < 128:
            return value, i


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        elif kind == 5:
            value, i = struct.unpack_from("<f", data, i)[0], i + 4
        elif kind == 1:
            value, i = struct.unpack_from("<d", data, i)[0], i + 8
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    drop_extra_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            m.pieces.append((f[1].decode(), f.get(2, 0.0), f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            m.kind, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif number == 3:
            f = dict(_fields(value))
            m.charsmap = f.get(2, b"")
            m.dummy_prefix, m.drop_extra_spaces, m.escape_spaces = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, best score first; the pieces' order among equals."""
    known = {p: (s, i) for i, (p, s, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    ways = [(-s, i, k) for p, (s, i) in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
    return [(m.pieces[i][0][:k], m.pieces[i][0][k:]) for _, i, k in sorted(ways)]


def rebuild(m: Model, cache: int = 10_000):
    """A tokenizers.Tokenizer of the model; cache: words that its own cache holds."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.kind == BPE:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=merges(m), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=cache)
    else:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unknown, byte_fallback=m.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.drop_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    return out


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        m = parse(data)
        self.threads = threads
        self.tokenizer = rebuild(m)
        self.words = rebuild(m, 0)  # every word comes once
        self.words.normalizer = None
        self.by_word = not m.charsmap and not m.drop_extra_spaces and m.escape_spaces and m.dummy_prefix and not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER))
        self.opens = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.lossy: set[bytes] = set()
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of whole texts, and whether they decode to the texts."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return ids, [a == b for a, b in zip(self.decode(ids), texts, strict=True)]

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words (each after its spaces), packed, in the cache; those that don't decode to themselves among the lossy ones.

        Words after one space are encoded ``TOGETHER`` at a time, as a text; a piece that starts with the marker starts a word.
        """
        single = [w for w in words if not w.startswith(b"  ")]
        groups = [single[k : k + TOGETHER] for k in range(0, len(single), TOGETHER)] + [[w] for w in words if w.startswith(b"  ")]
        for group, ids in zip(groups, self._encoded_groups(groups), strict=True):
            starts = np.flatnonzero(self.opens[np.array(ids, np.int64)]) if len(group) > 1 else np.zeros(1, np.int64)
            if len(starts) == len(group) and starts[0] == 0:
                self._keep(group, ids, starts.tolist())
            else:
                for w, x in zip(group, self._encoded_groups([[w] for w in group]), strict=True):
                    self._keep([w], x, [0])

    def _encoded_groups(self, groups: list[list[bytes]]) -> list[list[int]]:
        shown = [b"".join(g).decode("utf-8", "replace").replace(" ", MARK) for g in groups]
        return [e.ids for e in self.words.encode_batch_fast(shown, add_special_tokens=False)]

    def _keep(self, words: list[bytes], ids: list[int], starts: list[int]) -> None:
        ends = [*starts[1:], len(ids)]
        packed = np.array(ids, np.int32).tobytes()
        self.cache.update((w, packed[4 * a : 4 * b]) for w, a, b in zip(words, starts, ends, strict=True))
        # Decoding joins what the pieces stand for, so words are decoded together, and looked at singly only if that isn't their text.
        if self.words.decode(ids, skip_special_tokens=False) != b"".join(words)[1:].decode("utf-8", "replace"):
            own = self.words.decode_batch([ids[a:b] for a, b in zip(starts, ends, strict=True)], skip_special_tokens=False)
            self.lossy.update(w for w, x in zip(words, own, strict=True) if x != w[1:].decode("utf-8", "replace"))

    def _packs(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of different words."""
        if len(self.cache) + len(words) > CACHE:  # what was used since the last time stays for one more turn
            self.older, self.cache = self.cache, {}
            self.lossy.intersection_update([*self.older, *words])
        self.cache.update((w, self.older[w]) for w in words if w in self.older)
        if new := [w for w in words if w not in self.cache]:
            self._learn(new)
        return [self.cache[w] for w in words]

    def _by_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of each text's, and its round trip, of texts without markers. Empty texts have no ids."""
        n = len(column)
        _, offsets, data = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())).buffers()
        at = np.frombuffer(offsets, np.int64)[: n + 1]
        raw = np.frombuffer(data, np.uint8)[: at[-1]]
        empty = np.diff(at) == 1
        start = raw == 0x20
        start[1:] &= raw[:-1] != 0x20
        start[at[:-1]] = True
        start = np.flatnonzero(start)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, at[-1])), data]).dictionary_encode()
        known = words.dictionary.to_pylist()
        inverse = words.indices.to_numpy()
        packs = self._packs(known)
        size = np.fromiter(map(len, packs), np.int64, len(packs)) // 4
        ids = np.frombuffer(b"".join(packs), np.int32)
        origin = np.cumsum(size) - size
        row = np.searchsorted(at, start, "right") - 1
        inverse, row = inverse[~empty[row]], row[~empty[row]]
        each = size[inverse]
        ends = np.cumsum(each)
        flat = ids[np.repeat(origin[inverse] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        fits = np.ones(n, bool)
        if self.lossy:
            bad = np.fromiter((w in self.lossy for w in known), bool, len(known))
            fits[row[bad[inverse]]] = False
        return flat, np.bincount(row, each, n).astype(np.int64), fits

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of an Arrow column of texts: all ids, n + 1 offsets into them, parity and round trip."""
        gc.disable()  # nothing here makes cycles, and collections would walk the whole cache again and again
        try:
            return self._encoded(column)
        finally:
            gc.enable()

    def _encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        column = column.cast(pa.large_string()).fill_null("")
        if not self.by_word:
            apart = np.ones(len(column), bool)
        else:
            apart = pc.match_substring(column, MARK).to_numpy(zero_copy_only=False)
        texts = column.to_pylist()
        plain, rest = np.flatnonzero(~apart), np.flatnonzero(apart)
        counts, back = np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        flat = np.zeros(0, np.int32)
        if len(plain):
            flat, counts[plain], back[plain] = self._by_words(column.take(pa.array(plain)))
        if len(rest):
            ids, back[rest] = self.whole([texts[i] for i in rest])
            counts[rest] = [len(x) for x in ids]
            parts: list = [None] * len(texts)
            for i, x in zip(plain, np.split(flat, np.cumsum(counts[plain])[:-1]) if len(plain) else (), strict=True):
                parts[i] = x
            for i, x in zip(rest, ids, strict=True):
                parts[i] = np.array(x, np.int32)
            flat = np.concatenate(parts)
        at = np.concatenate([[0], np.cumsum(counts)])
        true = self.original.encode(texts, num_threads=self.threads)
        parity = np.fromiter(map(len, true), np.int64, len(true)) == counts
        if parity.all():
            unlike = np.flatnonzero(np.fromiter(itertools.chain.from_iterable(true), np.int32, at[-1]) != flat)
            parity[np.searchsorted(at, unlike, "right") - 1] = False
        else:
            parity &= [bool(np.array_equal(flat[a:b], x)) for a, b, x in zip(at[:-1], at[1:], true, strict=True)]
        return flat, at, parity, back


_CODECS: dict[tuple[bytes, int], Codec] = {}


def codec(data: bytes, threads: int) -> Codec:
    """The worker process's codec for a model; the last model's is kept for later tasks, with its words."""
    key = (data, threads)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None, threads: int = THREADS) -> DataFrame:
    """Columns ``keep`` of docs (all by default) with ids array<int>, n_tokens long, parity boolean and round_trip boolean."""
    arrow_rows(docs.sparkSession, 1024)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["ids", "n_tokens", "parity", "round_trip"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]

    def run(batches):
        codec_ = codec(held.value, threads)
        for b in batches:
            column = b.column(len(keep))
            parts = [codec_.encoded(column.slice(i, j - i)) for i, j in pieces(tv.texts(column)[1], SLICE)] or [codec_.encoded(column)]
            n = np.concatenate([np.diff(at) for _, at, _, _ in parts])
            flat, parity, back = (np.concatenate(x) for x in ([p[0] for p in parts], [p[2] for p in parts], [p[3] for p in parts]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32()), mask=column.is_null())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists, pa.array(n), pa.array(parity, pa.bool_()), pa.array(back, pa.bool_())], [*keep, *names])
        give_back()

    source = docs.select(*[docs[f"`{c}`"] for c in keep], docs[text].alias("__text"))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("parity", T.BooleanType()), T.StructField("round_trip", T.BooleanType())]
    return source.mapInArrow(run, T.StructType([*source.schema.fields[: len(keep)], *fields]))


def decode(tokens: DataFrame, model: bytes, ids: str = "ids", to: str = "text", threads: int = THREADS) -> DataFrame:
    """tokens with the text that each row's ids decode to (null for null ids) in column ``to``, which is replaced if there is one."""
    arrow_rows(tokens.sparkSession, 256)
    held = tokens.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in tokens.columns if c.lower() != to.lower()]

    def run(batches):
        codec_ = codec(held.value, threads)
        for b in batches:
            lists = b.column(len(keep)).to_pylist()
            texts = codec_.decode([x or [] for x in lists])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)], pa.string())], [*keep, to])

    source = tokens.select(*[tokens[f"`{c}`"] for c in keep], tokens[ids].alias("__ids"))
    return source.mapInArrow(run, T.StructType([*source.schema.fields[: len(keep)], T.StructField(to, T.StringType())]))
