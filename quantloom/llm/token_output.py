"""Token ids as binary blocks, packed by an adaptive context-mixing range coder.

Each order predicts: order 2 an id from the two before, order 1 an id from the one before (each with a confidence that
hits raise and misses lower), order 0 a whole distribution from the counts so far. The mixture of the three has weights
of its own for every pair of confidences, learned from how often each order was right there; it drives a range coder:
the id is coded as the order 2 prediction, else as the order 1 prediction, else by its share of the order 0 counts.

Every block starts with an empty model and carries a checksum, so blocks can be read alone. Within a block many lanes
(stretches of it) are coded side by side and teach the same model after every step, so numpy codes one id of each lane at
a time. All arithmetic is on integers, so every machine decodes what another has written.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import materialize, read

END_ID = 1
MAGIC = b"QTK4"
#: Ids of a segment (one stored row; a longer document makes a longer one), and stretches of text remembered.
SEGMENT_IDS, STRETCHES = 1 << 22, 300_000
#: Fixed values of the format: ids of a block at most; lanes of a block at most, and least steps of a lane; size of the order 2
#: table; steps between two mixings; weight of an id in the order 0 counts; shares of a mixture. A lane's interval is between
#: 2**46 and 2**62 wide, so an order and an id of order 0 are coded without a word in between; words are those above bit 46.
#: Shares of order 0 up to 2**FOUND_BITS are listed for reading.
BLOCK_IDS, LANES, LEAST_STEPS, ORDER_2_BITS, MIX_STEPS, COUNT, SHARES, FOUND_BITS = 1 << 20, 2048, 128, 18, 32, 32, 1 << 16, 18
BOTTOM, WIDEST = np.uint64(1 << 46), np.uint64((1 << 62) - 1)
_SHIFT, _HIGH = np.uint64(16), np.uint64(46)


#: What a hit adds to an entry's confidence (at most 15) and a miss takes from it (half), by confidence, misses first.
_CHANGE = np.array([-((c + 1) >> 1) for c in range(16)] + [1] * 15 + [0])


class _Model:
    """Predictions and mixing weights of one block. An entry of an order is id * 16 + confidence."""

    def __init__(self, n_ids: int, steps: int, lanes: int, finds: bool = False):
        kind = np.int32 if n_ids < 1 << 27 else np.int64  # small tables stay in the cache
        self.entries, self.change = np.zeros((1 << ORDER_2_BITS) + n_ids, dtype=kind), _CHANGE.astype(kind)  # order 2's, then order 1's
        self.one, self.hashed_two = np.zeros(lanes, dtype=np.uint32), np.zeros(lanes, dtype=np.uint32)
        self.slots = np.zeros((2, lanes), dtype=np.int64)
        self.keys, self.missed = np.full((steps, lanes), 3, dtype=np.int16), [np.zeros(0, dtype=np.int64)]  # 3: no order
        self.weights, self.counts = np.ones((512, 3), dtype=np.int64), np.ones(n_ids, dtype=np.int64)
        # order 0 shares 2**bits, a power of two so that nothing is divided by it
        self.n_ids, size = n_ids, n_ids.bit_length()
        self.bits = np.uint64(max(16, min(size + 4, 26), size))
        self.finds = finds and self.bits <= FOUND_BITS
        self.done, self.step = 0, 0
        self._mix()

    def _mix(self) -> None:
        """Turn counts into shares: of each key (confidences and order) of 2**16, and of each id in order 0."""
        self.weights += np.bincount(self.keys[self.done : self.step].reshape(-1), minlength=2048).reshape(512, 4)[:, :3] * 8
        width = np.maximum(self.weights * (SHARES - 4) // self.weights.sum(axis=1, keepdims=True), 1)
        width[:, 2] = SHARES - width[:, 0] - width[:, 1]
        self.start, self.width = np.zeros(2048, dtype=np.uint64), np.zeros(2048, dtype=np.uint64)
        self.width.reshape(512, 4)[:, :3] = width
        self.start.reshape(512, 4)[:, 1:3] = np.cumsum(width, axis=1)[:, :2]
        self.counts += np.bincount(np.concatenate(self.missed), minlength=self.n_ids + 1)[: self.n_ids] * COUNT
        self.missed = [np.zeros(0, dtype=np.int64)]
        # at least one for each id, what rounding leaves to the most frequent one; a last id, of all shares, for lanes without order 0
        whole = 1 << int(self.bits)
        share = self.counts * (whole - self.n_ids) // self.counts.sum() + 1
        share[np.argmax(self.counts)] += whole - share.sum()
        self.share, self.upto = np.append(share, whole).astype(np.uint64), np.zeros(self.n_ids + 1, dtype=np.uint64)
        np.cumsum(share[:-1], out=self.upto[1:-1].view(np.int64))
        if self.finds:
            self.owner = np.repeat(np.arange(self.n_ids, dtype=np.int32), share)
        self.done = self.step

    def predict(self, running: int) -> tuple[np.ndarray, np.ndarray]:
        """Key (order 2's) of each running lane, and the predictions of orders 2 and 1."""
        one, self.at = self.one[:running], self.slots[:, :running]
        self.at[0] = (one * np.uint32(0x9E3779B1) ^ self.hashed_two[:running]) >> np.uint32(32 - ORDER_2_BITS)
        np.add(one, 1 << ORDER_2_BITS, out=self.at[1])
        self.entry = self.entries.take(self.at)
        guess, self.sure = self.entry >> 4, self.entry & 15
        key = (self.sure[0] << 6) | (self.sure[1] << 2)
        key |= (guess[0] == guess[1]).astype(key.dtype) << 10
        return key.astype(np.int64), guess

    def find(self, targets: np.ndarray) -> np.ndarray:
        """The ids whose share of order 0 holds the targets; looked up in rising order, which keeps to the cache, if not in a list."""
        if self.finds:
            return self.owner.take(targets.view(np.int64))
        rising = np.argsort(targets)
        found = np.empty(len(targets), dtype=np.int64)
        found[rising] = np.searchsorted(self.upto[:-1], targets[rising], side="right") - 1
        return found

    def learn(self, key: np.ndarray, ids: np.ndarray, hit: np.ndarray, missed: np.ndarray) -> None:
        """``key`` of the order that coded each lane's id, whether orders 2 and 1 had it; ``missed`` are the ids that order 0 coded, n_ids standing for none."""
        n = len(ids)
        self.keys[self.step, :n] = key
        self.missed.append(missed)
        state = self.sure
        state += hit.astype(state.dtype) << 4
        changed = self.entry
        changed += self.change.take(state)
        # one without confidence gives way at a miss
        np.copyto(changed, ids.astype(changed.dtype) << 4, where=state <= 1)
        self.entries[self.at] = changed
        np.multiply(self.one[:n], np.uint32(0x85EBCA6B), out=self.hashed_two[:n])
        self.one[:n] = ids
        self.step += 1
        if self.step - self.done >= min(MIX_STEPS, max(1, self.done)):
            self._mix()


def _lanes(n: int) -> tuple[int, int]:
    """(lanes, steps) of a block of n ids: lanes of equal length, the last one shorter."""
    steps = max(LEAST_STEPS, -(-n // LANES))
    return -(-n // steps), steps


def _turned(table: np.ndarray) -> np.ndarray:
    """The table with rows for columns, 64 of its rows at a time, which stay in the cache."""
    turned = np.empty(table.shape[::-1], dtype=table.dtype)
    for i in range(0, len(table), 64):
        turned[:, i : i + 64] = table[i : i + 64].T
    return turned


def encode_block(symbols: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit words of all lanes one after another, number of words of each) for a block of numbers below n_ids."""
    lanes, steps = _lanes(len(symbols))
    ids = np.zeros(lanes * steps, dtype=np.int32)
    ids[: len(symbols)] = symbols
    ids = _turned(ids.reshape(lanes, steps))
    short = len(symbols) - (lanes - 1) * steps
    model = _Model(n_ids, steps, lanes)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, WIDEST)
    # the first words of all lanes, then the second ones, and so on
    out, used = np.zeros((4 * steps + 8) * lanes, dtype=np.uint32), np.arange(lanes)
    for t in range(steps):
        n = lanes if t < short else lanes - 1
        now, lo, wd = ids[t, :n], low[:n], width[:n]
        key, guess = model.predict(n)
        hit = guess == now
        order = (2 - hit[1].view(np.int8)) * (~hit[0]).view(np.int8)
        key |= order
        wd >>= _SHIFT
        lo += wd * model.start.take(key)
        wd *= model.width.take(key)
        z = np.where(order == 2, now, n_ids)
        wd >>= model.bits
        lo += wd * model.upto.take(z)
        wd *= model.share.take(z)
        model.learn(key, now, hit, z)
        need = np.flatnonzero(wd < BOTTOM)
        while len(need):
            a, at = lo[need], used[need]
            out[at] = a >> _HIGH  # a bit above the word is its carry
            used[need] = at + lanes
            lo[need] = (a & (BOTTOM - np.uint64(1))) << _SHIFT
            a = wd[need] << _SHIFT
            wd[need] = a
            need = need[a < BOTTOM]
    # at least 2**46 wide, so a start rounded up to 2**30 is inside whatever the next lane's words add to it
    low = (low + np.uint64((1 << 30) - 1)) >> np.uint64(30)
    out[used], out[used + lanes] = low >> _SHIFT, low & np.uint64(0xFFFF)
    sizes = used // lanes + 2
    rows = int(sizes.max())
    words = _turned(out[: rows * lanes].reshape(rows, lanes))[np.arange(rows) < sizes[:, None]]
    # no carry leaves a lane: all its intervals are within the first
    while len(over := np.flatnonzero(words > 0xFFFF)):
        words[over] &= 0xFFFF
        words[over - 1] += 1
    return words.astype("<u2"), sizes


def decode_block(words: np.ndarray, sizes: np.ndarray, length: int, n_ids: int) -> np.ndarray:
    """The numbers of a block, from what encode_block() gave. Damaged words give wrong numbers, never an error."""
    lanes, steps = _lanes(length)
    short = length - (lanes - 1) * steps
    # lanes lie one after another; a damaged lane may run past its end, at most to the padding
    stream = np.concatenate([words, np.zeros(4 * steps + 16, dtype=words.dtype)]).astype(np.uint64)
    used = np.cumsum(sizes) - sizes
    # how far the words are above the interval's start: first their upper 62 bits, then 16 more at a time, two bits late
    code = (stream[used] << np.uint64(46)) | (stream[used + 1] << np.uint64(30)) | (stream[used + 2] << np.uint64(14)) | (stream[used + 3] >> np.uint64(2))
    used += 4
    stream[1:] = ((stream[:-1] & np.uint64(3)) << np.uint64(14)) | (stream[1:] >> np.uint64(2))
    model = _Model(n_ids, steps, lanes, finds=True)
    width = np.full(lanes, WIDEST)
    ids = np.zeros((steps, lanes), dtype=np.int32)
    for t in range(steps):
        n = lanes if t < short else lanes - 1
        now, co, wd = ids[t, :n], code[:n], width[:n]
        key, guess = model.predict(n)
        wd >>= _SHIFT
        # without a division: whether the code reaches the shares of orders 1 and 0
        order = (co >= wd * model.start.take(key | 1)).astype(key.dtype)
        order += co >= wd * model.start.take(key | 2)
        key |= order
        co -= wd * model.start.take(key)
        wd *= model.width.take(key)
        wd >>= model.bits
        now[:] = np.where(order == 0, guess[0], guess[1])
        missed = np.flatnonzero(order == 2)
        unit, above = wd[missed], co[missed]
        z = model.find(np.minimum(above // unit, np.uint64((1 << int(model.bits)) - 1)))
        now[missed] = z
        wd <<= model.bits
        co[missed] = above - unit * model.upto.take(z)
        wd[missed] = unit * model.share.take(z)
        model.learn(key, now, guess == now, z)
        need = np.flatnonzero(wd < BOTTOM)
        while len(need):
            at = used[need]
            co[need] = (co[need] << _SHIFT) | stream.take(at, mode="clip")
            used[need] = at + 1
            a = wd[need] << _SHIFT
            wd[need] = a
            need = need[a < BOTTOM]
    return _turned(ids).reshape(-1)[:length]


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in rising order and the place of each id among them: by counting where ids are small, else by sorting."""
    if len(ids) and int(ids.max()) < 1 << 20:
        seen = np.bincount(ids) > 0
        return np.flatnonzero(seen).astype("<u4"), (np.cumsum(seen) - 1)[ids]
    names, place = np.unique(ids, return_inverse=True)
    return names, place.reshape(-1)


def pack_ids(ids: np.ndarray) -> bytes:
    """A segment: header and its crc32, the distinct ids in rising order, and a table, the lanes' sizes and the words of its blocks.

    Blocks code places in that list. Block table: ids, lanes, words, crc32 of the ids as unsigned little-endian 32-bit
    numbers. An empty array gives a segment without blocks.
    """
    ids = np.ascontiguousarray(ids, dtype="<u4")
    names, place = _distinct(ids)
    table, parts = [], []
    for i in range(0, len(ids), BLOCK_IDS):
        words, sizes = encode_block(place[i : i + BLOCK_IDS], len(names))
        own = ids[i : i + BLOCK_IDS]
        table.append((len(own), len(sizes), len(words), zlib.crc32(own.tobytes())))
        parts.append(sizes.astype("<u2").tobytes() + words.tobytes())
    head = struct.pack("<II", len(names), len(table)) + names.astype("<u4").tobytes() + np.array(table, dtype="<u4").tobytes()
    return b"".join([MAGIC, struct.pack("<I", zlib.crc32(head)), head, *parts])


def unpack_ids(segment: bytes) -> np.ndarray:
    """The ids of a segment; ValueError names the first block whose checksum fails."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    crc, n_names, n_blocks = struct.unpack_from("<III", segment, 4)
    at = 16 + 4 * n_names + 16 * n_blocks
    if zlib.crc32(segment[8:at]) != crc:
        raise ValueError("the header is damaged")
    names = np.frombuffer(segment, dtype="<u4", count=n_names, offset=16)
    table = np.frombuffer(segment, dtype="<u4", count=4 * n_blocks, offset=16 + 4 * n_names).reshape(-1, 4)
    found = [np.zeros(0, dtype="<u4")]
    for i, (length, lanes, n_words, checksum) in enumerate(table.tolist()):
        sizes = np.frombuffer(segment, dtype="<u2", count=lanes, offset=at).astype(np.int64)
        words = np.frombuffer(segment, dtype="<u2", count=n_words, offset=at + 2 * lanes)
        at += 2 * lanes + 2 * n_words
        if sizes.sum() != n_words:
            raise ValueError(f"block {i} is damaged")
        ids = names[decode_block(words, sizes, length, n_names)]
        if zlib.crc32(ids.tobytes()) != checksum:
            raise ValueError(f"block {i} is damaged")
        found.append(ids)
    return np.concatenate(found)


#: Letters of Latin-1, where each is composed and has one lower case, and signs. Letters with signs behind them are two pre-tokens.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_WORD, _PLAIN = f"^[{LETTERS}]+$", "^[a-z]+$"
#: Words of one text given to the library; bytes of text whose stretches are looked up together.
WORDS_AT_ONCE, RUN_BYTES = 128, 8 << 20
#: Rules that leave words of lower-case letters of Latin-1 as they are, but for the bytes above 127.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _joined(words: pa.Array) -> list[str]:
    """The words WORDS_AT_ONCE to a text, with blanks between."""
    bounds = np.append(np.arange(0, len(words), WORDS_AT_ONCE), len(words))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), pa.scalar(" ", words.type)).to_pylist()


def _packed(ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    """Ids one after another, cut into values of these numbers of ids."""
    own = np.concatenate([np.zeros(0, dtype="<u4"), *ids])
    upto = np.cumsum(np.concatenate([np.zeros(1, dtype=np.int64), *sizes])) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(upto) - 1, [None, pa.py_buffer(upto), pa.py_buffer(own)])


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all values one after another, where each value starts and the last one ends)."""
    upto = np.frombuffer(packed.buffers()[1], dtype=np.int64, count=packed.offset + len(packed) + 1)[packed.offset :] // 4
    data = packed.buffers()[2]
    ids = np.frombuffer(data, dtype="<u4", count=upto[-1]) if data else np.zeros(0, dtype="<u4")
    return ids[upto[0] :], upto - upto[0]


class StretchEncoder:
    """Ids of whole texts by the tokenizers library, which sees each blank-free stretch of text once while it is remembered.

    The tokenizer drops white space between pre-tokens and no pre-token, special string or composed character spans a
    blank, tab or line end, so the stretches between those can be encoded alone. By the rules of _NORMALIZER and _CUT words of
    letters are lower-cased and parted from signs; so they are here, and given to the library many in a text and without
    its normalizer and regular expressions; where one ends, its last id is of a vocabulary entry with the end-of-word
    suffix. By other rules the library gets stretches as they are. What is remembered is two Arrow arrays, of pieces and of
    their packed ids.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(model)
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used, self.runs = np.zeros(0, dtype=np.int64), 0
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.ends[[i for v, i in vocab.items() if suffix and v.endswith(suffix)]] = True
        self.plain = self.bytewise = None
        made = json.loads(model)
        rules = [(made.get(k) or {}).get(n) for k, n in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        if rules == [_NORMALIZER, _CUT] and not any(set(LETTERS).issuperset(t["content"]) for t in made.get("added_tokens") or []):
            self.plain, self.bytewise = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.bytewise.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _encode(self, texts: list[str], tokenizer) -> list[np.ndarray]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.frombuffer(array("I", e.ids), dtype="<u4") for e in found]

    def _encode_alone(self, texts: pa.Array) -> pa.Array:
        ids = self._encode(texts.to_pylist(), self.tokenizer)
        return _packed(ids, [np.array([len(i) for i in ids], dtype=np.int64)])

    def _encode_words(self, words: pa.Array, tokenizer) -> pa.Array:
        """The packed ids of words of letters, encoded many at a time; alone where their ends are not seen."""
        ids, sizes = self._encode(_joined(words), tokenizer), []
        for k, own in enumerate(ids):
            run = words.slice(k * WORDS_AT_ONCE, WORDS_AT_ONCE)
            upto = np.flatnonzero(self.ends[own]) + 1
            if len(upto) != len(run) or upto[-1] != len(own):
                alone = self._encode(run.to_pylist(), tokenizer)
                ids[k], upto = np.concatenate(alone), np.cumsum([len(i) for i in alone])
            sizes.append(np.diff(upto, prepend=0))
        return _packed(ids, sizes)

    def _look_up(self, pieces: pa.Array) -> np.ndarray:
        """Where the distinct pieces are among the remembered ones, asking the library for those not yet there."""
        found = pc.index_in(pieces, value_set=self.known)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        plain, word = (pc.match_substring_regex(pieces.take(pa.array(new)), w).to_numpy(zero_copy_only=False).copy() for w in (_PLAIN, _WORD))
        word &= self.plain is not None
        of = [new[word & plain], new[word & ~plain], new[~word]]
        at[np.concatenate(of)] = np.arange(len(self.known), len(self.known) + len(new))
        plain, word, other = (pieces.take(pa.array(n)) for n in of)
        self.ids = pa.concat_arrays([self.ids, self._encode_words(plain, self.plain), self._encode_words(word, self.bytewise), self._encode_alone(other)])
        self.known = pa.concat_arrays([self.known, plain, word, other])
        self.used = np.append(self.used, np.zeros(len(new), dtype=np.int64))
        self.used[at] = self.runs
        return at

    def _forget(self) -> None:
        """Drop long pieces, and of too many those not used for longest."""
        short = pc.less_equal(pc.binary_length(self.known), 64).to_numpy(zero_copy_only=False)
        if len(short) <= STRETCHES and short.all():
            return
        keep = np.flatnonzero(short)
        if len(keep) > STRETCHES:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: STRETCHES * 2 // 3]])
        self.known, self.ids, self.used = self.known.take(keep), self.ids.take(keep), self.used[keep]

    def encode_run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text starts and the last one ends)."""
        self.runs += 1
        cut = pc.ascii_split_whitespace(texts)
        stretches = cut.flatten().dictionary_encode()
        names = stretches.dictionary
        word = pc.utf8_rtrim(names, SIGNS)
        own = pc.and_(pc.match_substring_regex(word, _WORD), self.plain is not None)
        pieces = pa.concat_arrays([pc.if_else(own, pc.utf8_lower(word), names), pc.if_else(own, pc.utf8_ltrim(names, LETTERS), "")]).dictionary_encode()
        # each name's two pieces, then each stretch's name
        at = self._look_up(pieces.dictionary)[pieces.indices.to_numpy()]
        packed = self.ids.take(pa.array(at))
        packed = pc.binary_join_element_wise(packed[: len(names)], packed[len(names) :], pa.scalar(b"", pa.large_binary()))
        ids, upto = _unpacked(packed.take(stretches.indices))
        self._forget()
        return ids, upto[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, null ones taken as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        run = np.cumsum(pc.binary_length(texts).to_numpy()) // RUN_BYTES
        for of in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(run)) + 1):
            if len(of):
                ids, bounds = self.encode_run(texts.slice(of[0], len(of)))
                yield from np.split(ids, bounds[1:-1])


#: A stored segment.
STORED = pa.schema([("file_no", pa.int32()), ("segment_no", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("payload", pa.binary())])

_encoder: dict[int, StretchEncoder] = {}


def write_token_ids(docs: DataFrame, model: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and store the ids as segments in the shared folder.

    Returns the stored segments, reread: file_no, segment_no, doc_ids, lengths, n_ids, payload; file_no and segment_no give
    the order. Null texts count as empty, so every document has at least the end id; null doc_ids come first; of equal
    doc_ids the order is that of the texts' hashes. A document is never cut between segments.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if key not in _encoder:
            _encoder.clear()
            _encoder[key] = StretchEncoder(sent.value)
        encoder, file_no, segment_no = _encoder[key], TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = {"file_no": file_no, "segment_no": segment_no, "doc_ids": names, "lengths": [len(h) for h in held], "n_ids": len(ids), "payload": pack_ids(ids)}
            return pa.RecordBatch.from_pylist([row], schema=STORED)

        for batch in batches:
            for name, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
                if size and size + len(ids) >= SEGMENT_IDS:
                    yield segment()
                    segment_no, names, held, size = segment_no + 1, [], [], 0
                names.append(name)
                held.append(np.append(ids, np.uint32(END_ID)).astype("<u4"))
                size += len(ids) + 1
        if held:
            yield segment()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(run, "file_no int, segment_no int, doc_ids array<long>, lengths array<int>, n_ids long, payload binary"))


def read_token_ids(segments: DataFrame) -> DataFrame:
    """One row per document from stored segments: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_no, segment_no, doc_ids, lengths, payload in zip(*(batch[c] for c in ("file_no", "segment_no", "doc_ids", "lengths", "payload")), strict=True):
                ids = unpack_ids(payload)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                names = pd.array([None if pd.isna(d) else int(d) for d in doc_ids], dtype="Int64")
                yield pd.DataFrame({"doc_id": names, "file_no": file_no, "segment_no": segment_no, "within": starts, "n_tokens": lengths, "ids_crc32": crc})

    # ids of earlier segments of a file by a window for each file; ids of earlier files over one row for each writing task
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = segments.select("file_no", "segment_no", earlier(Window.partitionBy("file_no").orderBy("segment_no")).alias("in_file"))
    files = segments.groupBy("file_no").agg(F.sum("n_ids").alias("n_ids")).select("file_no", earlier(Window.orderBy("file_no")).alias("in_files"))
    starts = within.join(files, "file_no").select("file_no", "segment_no", (F.col("in_file") + F.col("in_files")).alias("before"))
    rows = segments.mapInPandas(run, "doc_id long, file_no int, segment_no int, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["file_no", "segment_no"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    return read_token_ids(write_token_ids(read(spark, sf_dir, "documents"), model))
