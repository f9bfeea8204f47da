"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling.

Each word has a restaurant for what follows it (its customers are the training tokens after that word). A table opened
there is a customer of the one word restaurant that all of them share as their parent. A table that one opens draws its
word from a spelling model, which is itself a hierarchy of Pitman-Yor restaurants over bytes: the restaurant of the last
four bytes has that of the last three as its parent, and so on down to no context and the uniform distribution.

Each Gibbs sweep seats all customers of all restaurants again, from the contexts up, given the predictive probabilities
and table totals of the sweep before, so restaurants and dishes are independent within a sweep and are sampled in
parallel. The predictive probabilities of the kept sweeps are averaged and scored.

Work on Spark: texts become chunks (rows of token numbers with the chunk's own word list). Words lie in groups by their
hash, pairs of words in buckets by theirs (so a hot context is spread over all), spelling restaurants in buckets by the
last two bytes of their context, which keeps a restaurant with its parent. Chunks, groups and buckets send each other
rows of packed arrays, one for each sender and receiver; only the spelling restaurants of less than two bytes (bounded by
the number of byte pairs) are on the driver and broadcast.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import ASCII_LOWER, discard, materialize, read

#: Tokens of one chunk (a longer document makes a longer one), bytes of spelling context, sweeps, and those not kept.
CHUNK_TOKENS, CONTEXT, SWEEPS, BURN_IN = 1 << 21, 4, 3, 1
#: Depths of the spelling model on the driver; words of chunks by which the number of groups is chosen (see _groups).
SHORT, GROUP = 2, 6400
STRENGTH, SPELLING_DISCOUNT = 1.0, 0.5
BLANK, SYMBOLS = 0x20, 256
BASE_ADD = 0.1


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator, exact: int = 256) -> np.ndarray:
    """Tables of each dish after its customers came in one by one.

    The next of i customers at t tables opens another with odds ``mass`` : i - discount * t, where ``mass`` is the
    restaurant's (strength + discount * tables) times the parent's probability of the dish. Beyond ``exact`` customers
    the odds are held over runs of 5 % of the customers so far, and a run's new tables are one binomial draw.
    """
    tables = (customers > 0).astype(np.int64)
    order = np.argsort(-customers, kind="stable")
    many, a, t = customers[order], mass[order], tables[order]
    i, most = 1, int(many[0]) if len(many) else 0
    while i < most:
        n = int(np.searchsorted(-many, -i, side="left"))
        if i < exact:
            t[:n] += rng.random(n) * (a[:n] + i - discount * t[:n]) < a[:n]
            i += 1
        else:
            run = max(1, i // 20)
            coming = np.minimum(run, many[:n] - i)
            t[:n] += rng.binomial(coming, np.clip(a[:n] / (a[:n] + i - discount * t[:n]), 0.0, 1.0))
            i += run
    tables[order] = t
    return tables


class Spelling:
    """Seated byte restaurants: for each depth, sorted keys (context and byte), and their predictive probabilities."""

    def __init__(self, depths: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], openings: list[np.ndarray] | None = None):
        self.depths = depths  # shallow first: keys, probabilities, context keys, mass a context leaves to its parent
        self.openings: list[np.ndarray] = openings or []

    def opening(self, contexts: np.ndarray, depth: int) -> np.ndarray:
        """strength + discount * tables of each context in this model; those it has not seen have the strength alone."""
        own = self.depths[depth][2]
        if not len(own):
            return np.full(len(contexts), STRENGTH)
        at = np.minimum(np.searchsorted(own, contexts), len(own) - 1)
        return np.where(own[at] == contexts, self.openings[depth][at], STRENGTH)

    @staticmethod
    def together(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and the customers of each, of rows (key, customers)."""
        keys, at = np.unique(rows[:, 0], return_inverse=True)
        return keys, np.bincount(at.reshape(-1), weights=rows[:, 1], minlength=len(keys)).astype(np.int64)

    @classmethod
    def seat_up(cls, rows: np.ndarray, depths: range, rng: np.random.Generator, before: Spelling | None) -> tuple[dict[int, tuple], np.ndarray]:
        """Seat rows (key, customers) that come to the deepest of ``depths``, then their tables at the depth above, and so on:
        (keys, customers, tables) of each depth, and the rows that come to the depth above all.

        Without a model ``before``, every dish starts with one table.
        """
        seated: dict[int, tuple] = {}
        for depth in reversed(depths):
            keys, customers = cls.together(rows)
            tables = np.ones(len(keys), dtype=np.int64)
            if before is not None:
                contexts, which = np.unique(keys >> 8, return_inverse=True)
                mass = before.opening(contexts, depth)[which.reshape(-1)] * before.probability(keys & _mask(depth), depth)
                tables = seat(customers, mass, SPELLING_DISCOUNT, rng)
            seated[depth] = (keys, customers, tables)
            rows = np.stack([keys & _mask(depth), tables], axis=1)
        return seated, rows

    def predict(self, seated: dict[int, tuple]) -> Spelling:
        """This model with the next depths, seated, added."""
        for depth in sorted(seated):
            keys, customers, tables = seated[depth]
            contexts, which = np.unique(keys >> 8, return_inverse=True)
            which = which.reshape(-1)
            total = STRENGTH + np.bincount(which, weights=customers, minlength=len(contexts))
            opening = STRENGTH + SPELLING_DISCOUNT * np.bincount(which, weights=tables, minlength=len(contexts))
            left = opening / total
            p = (customers - SPELLING_DISCOUNT * tables) / total[which] + left[which] * self.probability(keys & _mask(depth), depth)
            self.depths.append((keys, p, contexts, left))
            self.openings.append(opening)
        return self

    def probability(self, keys: np.ndarray, depths: int) -> np.ndarray:
        """Of the last byte of each key after the bytes before it, by the first ``depths`` depths."""
        if not depths:
            return np.full(len(keys), 1 / SYMBOLS)
        own, p, contexts, left = self.depths[depths - 1]
        shallower = self.probability(keys & _mask(depths - 1), depths - 1)
        if not len(own):
            return shallower
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        ctx = np.minimum(np.searchsorted(contexts, keys >> 8), len(contexts) - 1)
        return np.where(own[at] == keys, p[at], np.where(contexts[ctx] == keys >> 8, left[ctx], 1.0) * shallower)


def _mask(depth: int) -> int:
    """Keeps the byte and the context of the parent of ``depth`` (context length ``depth``, parent one shorter)."""
    return (1 << (8 * max(depth, 1))) - 1


def spelling_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key of each byte of each word and of the blank that ends it, where each word starts)."""
    text = np.frombuffer(b" ".join([*words, b""]) if words else b"", dtype=np.uint8).astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(words) else ends
    within = np.arange(len(text)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(text)]])))
    key = text.copy()
    for k in range(1, CONTEXT + 1):
        earlier = np.full(len(text), BLANK, dtype=np.int64)
        earlier[k:] = text[:-k]
        key |= np.where(within >= k, earlier, BLANK) << (8 * k)
    return key, starts


def pack(**arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one binary: bytes of like significance together, then zlib."""

    def one(a: np.ndarray | bytes) -> tuple[str, bytes]:
        if isinstance(a, bytes):
            return "", zlib.compress(a, 1)
        a = np.ascontiguousarray(a)
        return a.dtype.str, zlib.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)

    return pickle.dumps({k: one(a) for k, a in arrays.items()})


def unpack(data: bytes) -> dict:
    def one(kind: str, packed: bytes) -> np.ndarray | bytes:
        raw = zlib.decompress(packed)
        if not kind:
            return raw
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).reshape(-1)

    return {k: one(*a) for k, a in pickle.loads(data).items()}


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


#: A message: where it goes (group of words, bucket of pairs or of spellings, chunk), who sends it, what it is, packed arrays, sums.
MESSAGE = "place long, sender long, kind string, data binary, x double, y double, once long, twice long"
COLUMNS = [c.split()[0] for c in MESSAGE.split(", ")]


def _row(place: int, sender: int, kind: str, data: bytes, x: float = 0.0, y: float = 0.0, once: int = 0, twice: int = 0) -> tuple:
    return int(place), int(sender), kind, data, float(x), float(y), int(once), int(twice)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def _at_places(messages: list[DataFrame], run) -> DataFrame:
    """``run(place, {kind: [(sender, arrays)] by sender})`` for each place that any message goes to; it gives rows."""

    def at(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        by: dict[str, list] = {}
        for r in batch.sort_values("sender", kind="stable").itertuples(index=False):
            by.setdefault(r.kind, []).append((r.sender, unpack(r.data)))
        return _frame(list(run(int(key[0]), by)))

    return reduce(DataFrame.unionByName, messages).groupBy("place").applyInPandas(at, MESSAGE)


def _kind(messages: DataFrame, kind: str) -> DataFrame:
    found = messages.where(F.col("kind") == kind)
    found.part_of = messages
    return found


def _slices(where: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Of a sorted array: each value and its slice."""
    if not len(where):
        return
    names, starts = np.unique(where, return_index=True)
    for name, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(where)], strict=True):
        yield name, slice(a, b)


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def _spread(key: np.ndarray, n: int) -> np.ndarray:
    """Order of the spelling keys by (bucket of the last two context bytes, key), and the bucket of each in that order."""
    at = _bucket((key >> 8) & 0xFFFF, n)
    order = np.lexsort((key, at))
    return order, at[order]


def _word_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct spelling keys of a group's words, the key of each byte among them, and where each word starts."""
    key, starts = spelling_keys(blob.split(b"\n"))
    names, at = np.unique(key, return_inverse=True)
    return names, at.reshape(-1), starts


def to_chunks(docs: DataFrame) -> DataFrame:
    """Rows of about CHUNK_TOKENS tokens: chunk, doc_ids, held_out, lengths, n_words, tokens (numbers in ``words``), words (and counts).

    ``counts`` are the training tokens of each word in the chunk; the end of a text is the empty word.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, no = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        tokens: list[list[int]] = []
        number: dict[bytes, int] = _Numbers()
        size = 0

        def chunk() -> pd.DataFrame:
            ids = np.array([i for t in tokens for i in t], dtype=np.uint32)
            lengths = np.array([len(t) for t in tokens])
            trained = np.repeat(np.array([not held for _, held in rows]), lengths)
            counts = np.bincount(ids[trained], minlength=len(number))
            order = np.argsort(-np.bincount(ids, minlength=len(number)), kind="stable")
            place = np.empty(len(order), dtype="<u4")
            place[order] = np.arange(len(order))
            words = list(number)
            return pd.DataFrame(
                {
                    "chunk": [part << 32 | no], "doc_ids": [[r[0] for r in rows]], "held_out": [[r[1] for r in rows]], "lengths": [lengths], "n_words": [len(words)],
                    "tokens": [pack(tokens=place[ids])], "words": [pack(words=b"\n".join([words[i] for i in order.tolist()]), counts=counts[order])],
                }
            )

        for batch in batches:
            for doc_id, text, held in zip(batch["doc_id"], batch["text"], batch["held_out"], strict=True):
                rows.append((None if pd.isna(doc_id) else int(doc_id), bool(held)))
                tokens.append(list(map(number.__getitem__, [*(text or "").encode().translate(ASCII_LOWER).split(), b""])))
                size += len(tokens[-1])
                if size >= CHUNK_TOKENS:
                    yield chunk()
                    rows, tokens, number, size, no = [], [], _Numbers(), 0, no + 1
        if rows:
            yield chunk()

    return docs.mapInPandas(run, "chunk long, doc_ids array<long>, held_out array<boolean>, lengths array<long>, n_words long, tokens binary, words binary")


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _number_words(chunks: DataFrame, groups: int) -> DataFrame:
    """Messages ``words`` (a group's words and training counts) and ``places`` (for a chunk, its words' numbers in the group)."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                got = unpack(r.words)
                words = got["words"].split(b"\n")
                group = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % groups
                order = np.argsort(group, kind="stable")
                rows = []
                for g, s in _slices(group[order]):
                    own = order[s]
                    rows.append(_row(g, r.chunk, "ask", pack(words=b"\n".join([words[i] for i in own.tolist()]), counts=got["counts"][own], places=_steps(own))))
                yield _frame(rows)

    def number(group: int, by: dict) -> Iterator[tuple]:
        numbers, counts, chunks_of, found = _Numbers(), [], [], []
        for chunk, m in by["ask"]:
            found.append(np.array(list(map(numbers.__getitem__, m["words"].split(b"\n"))), dtype=np.int64))
            counts.append(m["counts"])
            chunks_of.append((chunk, m["places"]))
        c = np.bincount(np.concatenate(found), weights=np.concatenate(counts), minlength=len(numbers)).astype(np.int64)
        yield _row(group, -1, "words", pack(words=b"\n".join(numbers), c=c), c.sum(), (c > 0).sum())
        for (chunk, places), own in zip(chunks_of, found, strict=True):
            yield _row(chunk, group, "places", pack(own=own.astype(np.uint32), places=places))

    return materialize(_at_places([chunks.select("chunk", "words").mapInPandas(ask, MESSAGE)], number))


def _chunk_pairs(tokens: np.ndarray, numbers: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (previous word, word) of a chunk by (bucket, pair), the bucket of each, and each token's pair among them.

    A text's first word comes after the end of a text. ``tokens`` ends with one.
    """
    before = np.concatenate([tokens[-1:], tokens[:-1]]).astype(np.uint64)
    names, at = np.unique(before << np.uint64(32) | tokens.astype(np.uint64), return_inverse=True)
    key = numbers[(names >> np.uint64(32)).astype(np.int64)] << np.uint64(32) | numbers[(names & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    bucket = _bucket(key, buckets)
    order = np.lexsort((key, bucket))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return key[order], bucket[order], rank[at.reshape(-1)]


def _numbers(n_words: int, messages: list[tuple[int, dict]], groups: int) -> np.ndarray:
    """The number of each word of a chunk in the corpus: its number in the group times ``groups`` plus the group."""
    numbers = np.zeros(n_words, dtype=np.uint64)
    for group, m in messages:
        numbers[np.cumsum(m["places"])] = m["own"].astype(np.uint64) * np.uint64(groups) + np.uint64(group)
    if n_words and int(numbers.max()) >> 32:
        raise ValueError("more than 2^32 distinct words")
    return numbers


def _halves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _sums(bucket: int, kind: str, pairs: np.ndarray, tables: np.ndarray, groups: int) -> Iterator[tuple]:
    """What the tables of ``pairs`` bring to their words (as customers) and contexts (as tables), by group of words."""
    context, word = _halves(pairs)
    ids, at = np.unique(np.concatenate([context, word]), return_inverse=True)
    at = at.reshape(-1)
    opened = np.bincount(at[: len(context)], weights=tables, minlength=len(ids)).astype(np.int64)
    come = np.bincount(at[len(context) :], weights=tables, minlength=len(ids)).astype(np.int64)
    order = np.lexsort((ids, ids % groups))
    for g, s in _slices(ids[order] % groups):
        own = order[s]
        yield _row(g, bucket, kind, pack(ids=_steps(ids[own] // groups), come=come[own], opened=opened[own]))


def _count_pairs(chunks: DataFrame, places: DataFrame, groups: int, buckets: int) -> DataFrame:
    """Messages ``pairs`` (of a bucket: pairs of two training tokens or more), ``asked`` (for a chunk's pairs: 0 unseen, 1 seen
    once, else the place in ``pairs`` + 2), ``fixed`` and ``sums`` to the groups of words.

    A pair seen once has one table whatever the model says, so it is counted once and no sweep seats it.
    """

    def ask(key: tuple, own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        r = next(own.itertuples(index=False))
        numbers = _numbers(r.n_words, [(m.sender, unpack(m.data)) for m in replies.itertuples(index=False)], groups)
        pairs, bucket, at = _chunk_pairs(unpack(r.tokens)["tokens"], numbers, buckets)
        trained = np.repeat(~np.asarray(r.held_out, dtype=bool), np.asarray(r.lengths))
        counts = np.bincount(at[trained], minlength=len(pairs))
        return _frame([_row(b, r.chunk, "count", pack(pairs=_steps(pairs[s]), n=counts[s])) for b, s in _slices(bucket)])

    def count(bucket: int, by: dict) -> Iterator[tuple]:
        sizes = [len(m["n"]) for _, m in by["count"]]
        pairs, at = np.unique(np.concatenate([np.cumsum(m["pairs"], dtype=np.uint64) for _, m in by["count"]]), return_inverse=True)
        at = at.reshape(-1)
        c = np.bincount(at, weights=np.concatenate([m["n"] for _, m in by["count"]]), minlength=len(pairs)).astype(np.int64)
        many = c > 1
        place = np.where(many, np.cumsum(many) + 1, c).astype(np.uint32)
        ones = np.ones(int(many.sum()), dtype=np.int64)
        yield _row(bucket, -1, "pairs", pack(pairs=_steps(pairs[many]), c=c[many], kept=0 * ones), once=(c == 1).sum(), twice=(c == 2).sum())
        for (chunk, _), end, n in zip(by["count"], np.cumsum(sizes).tolist(), sizes, strict=True):
            yield _row(bucket, chunk, "asked", pack(place=place[at[end - n : end]]))
        yield from _sums(bucket, "fixed", pairs[c == 1], np.ones(int((c == 1).sum())), groups)
        yield from _sums(bucket, "sums", pairs[many], ones, groups)

    asked = chunks.drop("doc_ids", "words").groupBy("chunk").cogroup(places.groupBy("place")).applyInPandas(ask, MESSAGE)
    return materialize(_at_places([asked], count))


def _seat_words(parts: list[DataFrame], groups: int, discount: float, opening: float, seed: tuple) -> DataFrame:
    """Messages ``state`` (customers n, tables t, and tables opened in each word's own restaurant) and ``spell`` to the spellings."""

    def run(group: int, by: dict) -> Iterator[tuple]:
        blob = by["words"][0][1]["words"]
        names, at, starts = _word_keys(blob)
        n, opened = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        for _, m in by.get("fixed", []) + by.get("sums", []):
            ids = np.cumsum(m["ids"])
            n[ids] += m["come"]
            opened[ids] += m["opened"]
        before = by["state"][0][1] if "state" in by else {}
        t = seat(n, opening * 10.0 ** before["spelling"].astype(float), discount, np.random.default_rng((*seed, group))) if before else np.minimum(n, 1)
        kept = {k: v for k, v in before.items() if k[0] in "PO"}
        yield _row(group, -1, "state", pack(n=n, t=t, opened=opened, **kept), n.sum(), t.sum(), (n == 1).sum(), (n == 2).sum())
        customers = np.bincount(at, weights=np.repeat(t, np.diff(np.append(starts, len(at)))), minlength=len(names)).astype(np.int64)
        order, bucket = _spread(names, groups)
        for b, s in _slices(bucket):
            yield _row(b, group, "spell", pack(keys=_steps(names[order[s]]), n=customers[order[s]]))

    return materialize(_at_places(parts, run))


def _seat_spellings(parts: list[DataFrame], before: Spelling | None, seed: tuple) -> tuple[DataFrame, Spelling]:
    """Messages ``seated`` (restaurants of two context bytes or more, which stay where their last two bytes put them), and
    the model of the shorter contexts: at most 256 and 65,536 rows, whatever the input."""
    sent = parts[0].sparkSession.sparkContext.broadcast(before)

    def run(bucket: int, by: dict) -> Iterator[tuple]:
        old = _deep(sent.value, by["seated"][0][1]) if sent.value else None
        rows = np.concatenate([np.stack([np.cumsum(m["keys"]), m["n"]], axis=1) for _, m in by["spell"]])
        seated, arriving = Spelling.seat_up(rows[rows[:, 1] > 0], range(SHORT, CONTEXT + 1), np.random.default_rng((*seed, bucket)), old)
        up = Spelling.together(arriving)
        yield _row(bucket, -1, "seated", pack(**{f"{name}{d}": a for d, x in seated.items() for name, a in (("keys", _steps(x[0])), ("n", x[1]), ("t", x[2]))}))
        yield _row(bucket, -1, "up", pack(keys=up[0], n=up[1]))

    seated = materialize(_at_places(parts, run))
    keys, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for r in _kind(seated, "up").select("data").toLocalIterator():
        m = unpack(r.data)
        keys, n = Spelling.together(np.stack([np.concatenate([keys, m["keys"]]), np.concatenate([n, m["n"]])], axis=1))
    short, _ = Spelling.seat_up(np.stack([keys, n], axis=1), range(SHORT), np.random.default_rng(seed), before)
    return _kind(seated, "seated"), Spelling([]).predict(short)


def _deep(short: Spelling, m: dict) -> Spelling:
    return Spelling(list(short.depths), list(short.openings)).predict({d: (np.cumsum(m[f"keys{d}"]), m[f"n{d}"], m[f"t{d}"]) for d in range(SHORT, CONTEXT + 1)})


def _predict_words(parts: list[DataFrame], spell: list[DataFrame], short: Spelling, groups: int, discounts: tuple[float, float], total: float, opening: float, keep: int | None, last: bool) -> DataFrame:
    """Messages ``state`` (with the spelling's probability, and P and O of the kept sweeps) and ``parents`` to the buckets of pairs."""
    sent = parts[0].sparkSession.sparkContext.broadcast(short)

    def answer(bucket: int, by: dict) -> Iterator[tuple]:
        model = _deep(sent.value, by["seated"][0][1])
        for group, m in by["spell"]:
            yield _row(group, bucket, "spelled", pack(p=model.probability(np.cumsum(m["keys"]), CONTEXT + 1)))

    def run(group: int, by: dict) -> Iterator[tuple]:
        names, at, starts = _word_keys(by["words"][0][1]["words"])
        p = np.empty(len(names))
        p[_spread(names, groups)[0]] = np.concatenate([m["p"] for _, m in by["spelled"]])
        m = by["state"][0][1]
        spelling = np.add.reduceat(np.log10(p)[at], starts)
        new_log = math.log10(opening / (STRENGTH + total)) + spelling
        new, seen = 10.0**new_log, m["n"] > 0
        word = (m["n"] - discounts[0] * m["t"]) / (STRENGTH + total) + new
        if keep is not None:  # as logarithms: the probability of a long unknown word can be too small for a float
            m |= {f"P{keep}": np.where(seen, np.log10(np.where(seen, word, 1.0)), new_log), f"O{keep}": m["opened"]}
        yield _row(group, -1, "state", pack(**m | {"spelling": spelling.astype(np.float32)}), new[seen].sum())
        for bucket, s in by.get("sums", []) if not last else []:
            ids = np.cumsum(s["ids"])
            yield _row(bucket, group, "parents", pack(p=word[ids].astype(np.float32), opening=(STRENGTH + discounts[1] * m["opened"][ids]).astype(np.float32)))

    return materialize(_at_places([*parts, _at_places(spell, answer)], run))


def _seat_pairs(parts: list[DataFrame], groups: int, discount: float, keep: bool, seed: tuple) -> DataFrame:
    """Messages ``pairs`` (with the kept sweeps' tables) and ``sums``: the context restaurants' tables, seated again."""

    def run(bucket: int, by: dict) -> Iterator[tuple]:
        m = by["pairs"][0][1]
        pairs = np.cumsum(m["pairs"], dtype=np.uint64)
        context, word = _halves(pairs)
        ids = np.unique(np.concatenate([context, word]))
        order = np.lexsort((ids, ids % groups))
        p, opening = np.zeros(len(ids)), np.zeros(len(ids))
        if len(ids):
            p[order] = np.concatenate([x["p"] for _, x in by["parents"]])
            opening[order] = np.concatenate([x["opening"] for _, x in by["parents"]])
        t = seat(m["c"], opening[np.searchsorted(ids, context)] * p[np.searchsorted(ids, word)], discount, np.random.default_rng((*seed, bucket)))
        yield _row(bucket, -1, "pairs", pack(pairs=m["pairs"], c=m["c"], kept=m["kept"] + t * keep))
        yield from _sums(bucket, "sums", pairs, t, groups)

    return materialize(_at_places(parts, run))


def _discount(once: int | None, twice: int | None) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05 if twice else 0.5


def fit(words: DataFrame, fixed: DataFrame, groups: int, pairs: DataFrame | None, sums: DataFrame | None, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 11) -> tuple[DataFrame, DataFrame | None, list[float], float]:
    """Sweeps over all restaurants: the groups' last states, the buckets' last pairs, the probability of an unknown word in
    the word restaurant in each kept sweep, and the discount of the context restaurants.

    ``words``, ``fixed``, ``pairs`` and ``sums`` are messages. Without pairs the words' customers are those of ``fixed``.
    """
    of_pairs = _discount(*pairs.agg(F.sum("once"), F.sum("twice")).first()) if pairs is not None else 0.0
    state, seated, short, found, unknown = None, None, None, None, []
    discount = opening = 0.0
    for sweep in range(sweeps + 1):
        old = [state, found, seated and seated.part_of]  # not read again once this sweep's tables are written
        if sweep and pairs is not None:
            found = _seat_pairs([pairs, _kind(state, "parents")], groups, of_pairs, sweep > burn_in, (seed, sweep, 0))
            pairs, sums = _kind(found, "pairs"), _kind(found, "sums")
        asks = [sums] if sums is not None else []
        moved = _seat_words([words, fixed, *asks, *([_kind(state, "state")] if sweep else [])], groups, discount, opening, (seed, sweep, 1))
        total, tables, once, twice = (x or 0 for x in _kind(moved, "state").agg(F.sum("x"), F.sum("y"), F.sum("once"), F.sum("twice")).first())
        discount = discount or _discount(once, twice)
        opening = STRENGTH + discount * tables
        seated, short = _seat_spellings([_kind(moved, "spell"), *([seated] if sweep else [])], short, (seed, sweep, 2))
        keep = sweep - burn_in - 1 if sweep > burn_in else None
        state = _predict_words([words, _kind(moved, "state"), *asks], [_kind(moved, "spell"), seated], short, groups, (discount, of_pairs), total, opening, keep, sweep == sweeps)
        discard(moved, *old)
        if keep is not None:
            known = _kind(state, "state").agg(F.sum("x")).first()[0] or 0.0
            unknown.append(max(opening / (STRENGTH + total) - known, 1e-300))
    return _kind(state, "state"), pairs, unknown, of_pairs


def fit_words(words: DataFrame, **options) -> tuple[DataFrame, float]:
    """(word, c, p) and the probability of an unknown word: training count and averaged predictive probability of every word
    of ``words`` (word, c) in a word restaurant whose customers are ``c``, spelling included for those without count.

    The unknown word is any word without count: what new tables draw, less what they draw of known words. So it and the
    probabilities of the known words add up to 1.
    """
    groups = _groups(words.count())

    def gather(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        c = batch["c"].to_numpy(dtype=np.int64)
        ids = np.arange(len(c))
        return _frame([_row(key[0], -1, "words", pack(words=b"\n".join(batch["word"]), c=c)), _row(key[0], -1, "fixed", pack(ids=_steps(ids), come=c, opened=0 * c))])

    found = materialize(words.groupBy((F.crc32("word") % groups).alias("g")).applyInPandas(gather, MESSAGE))
    state, _, unknown, _ = fit(_kind(found, "words"), _kind(found, "fixed"), groups, None, None, **options)

    def table(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        by = {r.kind: unpack(r.data) for r in batch.itertuples(index=False)}
        kept = [v for k, v in by["state"].items() if k[0] == "P"]
        return pd.DataFrame({"word": by["words"]["words"].split(b"\n"), "c": by["words"]["c"], "p": np.mean(10.0 ** np.array(kept), axis=0)})

    rows = state.unionByName(_kind(found, "words")).groupBy("place").applyInPandas(table, "word binary, c long, p double")
    return rows, float(np.mean(unknown))


def _groups(words: int) -> int:
    """Groups of words for so many words of chunks: their number and their size both grow with its root, so messages stay linear."""
    return max(1, math.ceil(math.sqrt(words / GROUP)))


def score_texts(docs: DataFrame, **options) -> DataFrame:
    """``docs``: doc_id, text, held_out. One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    spelled_score.

    base_score and score are over the same events, the known words and one unknown word; spelled_score also pays for the
    letters of unknown words. Each token is predicted after the word before it. Learns from the rows that are not held out.
    Null texts count as empty: one token, the end. Rows are scored one by one, repeated or not; without training rows every
    word falls to the uniform spelling.
    """
    chunks = materialize(to_chunks(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out")))
    groups = _groups(chunks.agg(F.sum("n_words")).first()[0] or 0)
    buckets = 2 * groups
    numbered = _number_words(chunks, groups)
    words, places = _kind(numbered, "words"), _kind(numbered, "places")
    total, distinct = (int(x or 0) for x in words.agg(F.sum("x"), F.sum("y")).first())
    counted = _count_pairs(chunks, places, groups, buckets)
    state, pairs, unknown, discount = fit(words, _kind(counted, "fixed"), groups, _kind(counted, "pairs"), _kind(counted, "sums"), **options)
    kept = len(unknown)

    def words_of(group: int, by: dict) -> Iterator[tuple]:
        c, m = by["words"][0][1]["c"], by["state"][0][1]
        values = {"c": c} | {f"P{k}": m[f"P{k}"].astype(np.float32) for k in range(kept)} | {f"L{k}": ((STRENGTH + discount * m[f"O{k}"]) / (STRENGTH + c)).astype(np.float32) for k in range(kept)}
        for chunk, x in by["places"]:
            yield _row(chunk, group, "words", pack(**x, **{name: v[x["own"]] for name, v in values.items()}))

    def pairs_of(bucket: int, by: dict) -> Iterator[tuple]:
        m = by["pairs"][0][1]
        own = np.concatenate([[0.0, 1.0 - discount], m["c"] - discount * m["kept"] / kept]).astype(np.float32)
        for chunk, x in by["asked"]:
            yield _row(chunk, bucket, "pairs", pack(own=own[x["place"]]))

    to_groups = places.select(F.col("sender").alias("place"), F.col("place").alias("sender"), *COLUMNS[2:])
    answers = _at_places([words, state, to_groups], words_of).unionByName(_at_places([pairs, _kind(counted, "asked")], pairs_of))
    base_total = total + BASE_ADD * (distinct + 1)

    def run(key: tuple, chunk: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        r = next(chunk.itertuples(index=False))
        by: dict[str, list] = {"words": [], "pairs": []}
        for m in replies.sort_values("sender").itertuples(index=False):
            by[m.kind].append((m.sender, unpack(m.data)))
        of = {name: np.zeros(r.n_words) for name in ["c", *(f"{x}{k}" for x in "PL" for k in range(kept))]}
        for _, m in by["words"]:
            for name, v in of.items():
                v[np.cumsum(m["places"])] = m[name]
        tokens, lengths = unpack(r.tokens)["tokens"], np.asarray(r.lengths)
        _, _, at = _chunk_pairs(tokens, _numbers(r.n_words, by["words"], groups), buckets)
        before = np.concatenate([tokens[-1:], tokens[:-1]])
        count, own = of["c"][tokens], np.concatenate([m["own"] for _, m in by["pairs"]])[at] / (STRENGTH + of["c"][before])
        left, logs = [of[f"L{k}"][before] for k in range(kept)], [of[f"P{k}"][tokens] for k in range(kept)]
        top = np.max(logs, axis=0)  # own is 0 where a word is unknown, so nothing overflows
        spelled_log = top + np.log10(own * 10.0 ** np.where(count > 0, -top, 0.0) + sum(a * 10.0 ** (b - top) for a, b in zip(left, logs, strict=True)) / kept)
        unknown_log = np.log10(sum(a * b for a, b in zip(left, unknown, strict=True)) / kept)
        values = {
            "n_known": (count > 0).astype(np.int64), "base_score": np.log10((count + BASE_ADD) / base_total),
            "score": np.where(count > 0, spelled_log, unknown_log), "spelled_score": spelled_log,
        }
        starts = np.cumsum(lengths) - lengths
        ids = pd.array([None if pd.isna(d) else int(d) for d in r.doc_ids], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "held_out": r.held_out, "n_tokens": lengths, "train_tokens": total, **{name: np.add.reduceat(v, starts) for name, v in values.items()}})[OUT_COLUMNS]

    return chunks.drop("words").groupBy("chunk").cogroup(answers.groupBy("place")).applyInPandas(run, OUT)


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double"
OUT_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0
    return score_texts(read(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out")))
