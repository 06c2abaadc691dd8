"""Phrases whose words keep company, counted in counting quotient filters.

1. Texts are cut into slices of words; a slice holds its distinct words and, for each place, the number of its word. Shards
   by hash add up the words' counts, give those that are frequent enough an id, and answer each slice with its words' ids.
2. N-grams of ids, from two words up, are packed into one number of n x b bits and permuted. Its upper bits are the
   quotient, all the others the remainder, so that nothing is lost and equal permuted numbers are equal n-grams. A slice's filter
   is its sorted quotients' run lengths, the remainders packed bit by bit, and the counts; shards are ranges of quotients. A shard merges
   its slices' sorted filters, keeps the n-grams that are frequent enough and answers each slice with one bit per n-gram.
3. An n-gram can only be as frequent as the shorter ones inside it, so a slice goes on with the stretches in which all n-grams are
   frequent. That loses nothing, and little is left from three words on.

Scores, cuts and the comparison with longer phrases are joins of the frequent n-grams' counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstream.llm.common import LARGE_ROWS, ascii_lower, byte_set, mixed, run_hashes, slices, text_of, utf8, written

LEAST, LONGEST, TOP = 30, 4, 2000
#: A longer phrase that has at least this part of a phrase's occurrences, in percent, takes its place.
ABSORBS = 80
SCALE = 2_000_000
NO_LANG = "und"
#: What ends a piece of text, and what stands between its words.
ENDS_PIECE = b".,;:!?\n\x0b\x0c\r"
BETWEEN = b" \t"
#: Entries that one shard holds on average.
SHARD = 1 << 20
_ROUNDS = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))

# ---- numbers of a fixed width, bit by bit


def packed(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, one after another."""
    if not width or not len(values):
        return b""
    bytes_of = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(bytes_of[:, :-(-width // 8)], axis=1, count=width, bitorder="little")
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(data: bytes, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros((n, 8), np.uint8)
    found = np.packbits(bits, axis=1, bitorder="little")
    out[:, :found.shape[1]] = found
    return out.view("<u8").ravel().astype(np.uint64)


def _small(values: np.ndarray) -> bytes:
    """Numbers that are mostly under 255: a byte each, the greater ones whole at the end."""
    large = values >= 255
    return np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype("<u8").tobytes()


def _read_small(data: bytes, n: int) -> np.ndarray:
    found = np.frombuffer(data, np.uint8, n).astype(np.int64)
    large = found == 255
    found[large] = np.frombuffer(data, "<u8", -1, n).astype(np.int64)
    return found


# ---- the filter


class Packing:
    """N-grams of ``n`` ids of ``bits`` bits as one number of two halves, and its permutation."""

    def __init__(self, n: int, bits: int):
        self.n, self.bits = n, bits
        self.half = -(-n * bits // 2)
        if self.half > 64:
            raise ValueError("more than 128 bits: fewer words to a phrase")
        self.mask = np.uint64((1 << self.half) - 1)

    def pack(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        high = low = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            # one place up: what leaves the lower half enters the upper one
            b, h = self.bits, self.half
            column = column.astype(np.uint64)
            if b >= h:
                # two ids and no more: a half each
                high, low = low, column
                continue
            high = ((high << np.uint64(b)) | (low >> np.uint64(h - b))) & self.mask
            low = ((low << np.uint64(b)) | column) & self.mask
        return high, low

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        found, b, h = [], self.bits, self.half
        for _ in range(self.n):
            if b >= h:
                found.append(low)
                high, low = np.zeros_like(high), high
                continue
            found.append(low & np.uint64((1 << b) - 1))
            low = (low >> np.uint64(b)) | ((high << np.uint64(h - b)) & self.mask)
            high = high >> np.uint64(b)
        return [f.astype(np.int64) for f in reversed(found)]

    def permuted(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One-to-one: each round changes one half by what the other is."""
        for k in _ROUNDS:
            high, low = low, high ^ (mixed(low ^ k) & self.mask)
        return high, low

    def restored(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in reversed(_ROUNDS):
            high, low = low ^ (mixed(high ^ k) & self.mask), high
        return high, low

    def order(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        if 2 * self.half <= 64:
            return np.argsort((high << np.uint64(self.half)) | low, kind="stable")
        return np.lexsort((low, high))


class Filter:
    """A counting quotient filter: distinct permuted n-grams in order, and how often each was counted.

    The first ``shard_bits`` bits are the shard's number, which all its n-grams share; ``quotient`` more are the quotient.
    """

    def __init__(self, packing: Packing, high: np.ndarray, low: np.ndarray, counts: np.ndarray):
        self.packing, self.high, self.low, self.counts = packing, high, low, counts

    @staticmethod
    def counted(packing: Packing, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[Filter, np.ndarray]:
        """The filter of permuted n-grams that may repeat, and which of its entries each of them is."""
        order = packing.order(high, low)
        sorted_high, sorted_low = high[order], low[order]
        first = np.empty(len(order), bool)
        first[:1] = True
        first[1:] = (sorted_high[1:] != sorted_high[:-1]) | (sorted_low[1:] != sorted_low[:-1])
        at = np.flatnonzero(first)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(first) - 1
        if counts is None:
            sums = np.diff(np.append(at, len(order)))
        else:
            sums = np.add.reduceat(counts[order], at) if len(at) else np.empty(0, np.int64)
        return Filter(packing, sorted_high[at], sorted_low[at], sums), entry

    @staticmethod
    def merged(filters: list[Filter]) -> tuple[Filter, list[np.ndarray]]:
        """All filters as one, and which of its entries each of theirs is."""
        whole, entry = Filter.counted(filters[0].packing, *(np.concatenate([getattr(f, c) for f in filters]) for c in ("high", "low", "counts")))
        return whole, np.split(entry, np.cumsum([len(f.high) for f in filters])[:-1])

    def parts(self, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The shards that have entries, and where each one's begin (and the last ends)."""
        shard = self.high >> np.uint64(self.packing.half - shard_bits) if shard_bits else np.zeros(len(self.high), np.uint64)
        begins = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1))
        return shard[begins].astype(np.int64), np.append(begins, len(shard))

    def write(self, begin: int, end: int, shard_bits: int) -> bytes:
        high, n, half = self.high[begin:end], end - begin, self.packing.half
        quotient_bits = min(half - shard_bits, int(n).bit_length())
        rest_bits = half - shard_bits - quotient_bits
        quotient = ((high >> np.uint64(rest_bits)) & np.uint64((1 << quotient_bits) - 1)).astype(np.int64)
        runs = _small(np.bincount(quotient, minlength=1 << quotient_bits))
        upper, lower = packed(high & np.uint64((1 << rest_bits) - 1), rest_bits), packed(self.low[begin:end], half)
        head = np.array([n, quotient_bits, len(runs), len(upper), len(lower)], "<i8").tobytes()
        return b"".join((head, runs, upper, lower, _small(self.counts[begin:end])))

    @staticmethod
    def read(packing: Packing, data: bytes, shard: int, shard_bits: int) -> Filter:
        n, quotient_bits, *sizes = np.frombuffer(data, "<i8", 5).tolist()
        parts, at = [], 40
        for size in sizes:
            parts.append(data[at:at + size])
            at += size
        rest_bits = packing.half - shard_bits - quotient_bits
        quotient = np.repeat(np.arange(1 << quotient_bits, dtype=np.uint64), _read_small(parts[0], 1 << quotient_bits))
        high = (quotient << np.uint64(rest_bits)) | unpacked(parts[1], rest_bits, n) if rest_bits < 64 else unpacked(parts[1], rest_bits, n)
        if shard_bits:
            high |= np.uint64(shard << (packing.half - shard_bits))
        return Filter(packing, high, unpacked(parts[2], packing.half, n), _read_small(data[at:], n))


# ---- words

_SPLIT, _SPACES = byte_set(ENDS_PIECE), byte_set(BETWEEN)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of its piece; texts begin at ``offsets``."""
    ends_piece = _SPLIT[data]
    inside = ~(ends_piece | _SPACES[data])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1]))) if len(data) else np.empty(0, np.int64)
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1 if len(data) else np.empty(0, np.int64)
    piece = np.cumsum(ends_piece)[starts] if len(data) else starts
    return starts, ends, piece + np.searchsorted(offsets, starts, "right")


_SLICE = "slice long, lang_names array<string>, n long, langs binary, sizes binary, words binary, counts binary, codes binary"


def _word_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's distinct words by hash, their languages and counts, and the places' word numbers (from 1, 0 between pieces)."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = utf8(part.column("text"))
            data = ascii_lower(data)
            starts, ends, piece = _words(data, offsets)
            if not len(starts):
                continue
            langs = pc.dictionary_encode(part.column("lang"))
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.searchsorted(offsets, starts, "right") - 1]
            size = ends - starts
            upto = np.cumsum(size)
            joined = data[np.arange(upto[-1]) + np.repeat(starts - (upto - size), size)]
            spelled = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, upto)), pa.py_buffer(joined)])
            spelled = spelled.dictionary_encode()
            word = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pair, which, count = np.unique(word * len(langs.dictionary) + lang, return_inverse=True, return_counts=True)
            lang, texts = pair % len(langs.dictionary), spelled.dictionary.take(pa.array(pair // len(langs.dictionary)))
            order = np.argsort(_hashes(texts, lang, langs.dictionary.to_pylist()), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            gap = np.diff(piece, prepend=piece[0]) > 0
            codes = np.zeros(len(which) + int(gap.sum()), np.int64)
            codes[np.arange(len(which)) + np.cumsum(gap)] = place[which] + 1
            texts = texts.take(pa.array(order))
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([number], pa.int64()), "lang_names": pa.array([langs.dictionary.to_pylist()], pa.list_(pa.string())),
                "n": pa.array([len(order)], pa.int64()),
                **{name: pa.array([value], pa.binary()) for name, value in (
                    ("langs", lang[order].astype("<u4").tobytes()),
                    ("sizes", pc.binary_length(texts).to_numpy().astype("<u4").tobytes()),
                    ("words", b"".join(texts.to_pylist())), ("counts", _small(count[order])), ("codes", codes.astype("<i4").tobytes()))}})
            number += 1


def _hashes(texts: pa.Array, lang: np.ndarray, names: list[str]) -> np.ndarray:
    """Which shard a word goes to; words are told apart by what they are."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    found = run_hashes(np.frombuffer(b"".join(texts.to_pylist()), np.uint8), np.append(0, ends[:-1]), ends)
    name = [name.encode() for name in names]
    ends = np.cumsum([len(n) + 1 for n in name])
    salt = run_hashes(np.frombuffer(b"".join(n + b"\0" for n in name), np.uint8), np.append(0, ends[:-1]), ends)
    return mixed(found ^ salt[lang])


def _spelled(row: dict) -> tuple[pa.Array, np.ndarray]:
    """The words of a packed row, and their languages' numbers."""
    upto = np.append(0, np.cumsum(np.frombuffer(row["sizes"], "<u4").astype(np.int64)))
    words = pa.Array.from_buffers(pa.large_binary(), len(upto) - 1, [None, pa.py_buffer(upto), pa.py_buffer(row["words"])])
    return words, np.frombuffer(row["langs"], "<u4").astype(np.int64)


def _shard_bits(entries: int) -> int:
    return max(0, min(40, (entries // SHARD).bit_length()))


def _ask_words(bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, lang = _spelled(row)
                counts, ends = _read_small(row["counts"], row["n"]), words.buffers()[1]
                ends = np.frombuffer(ends, np.int64)
                shard = _hashes(words, lang, row["lang_names"]) >> np.uint64(64 - bits) if bits else np.zeros(row["n"], np.uint64)
                begins = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1)).tolist()
                for a, b in zip(begins, [*begins[1:], row["n"]], strict=True):
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([int(shard[a])], pa.int64()), "slice": pa.array([row["slice"]], pa.int64()),
                        "lang_names": pa.array([row["lang_names"]], pa.list_(pa.string())), "n": pa.array([b - a], pa.int64()),
                        **{name: pa.array([value], pa.binary()) for name, value in (
                            ("langs", row["langs"][4 * a:4 * b]), ("sizes", row["sizes"][4 * a:4 * b]),
                            ("words", row["words"][ends[a]:ends[b]]), ("counts", _small(counts[a:b])))}})
    return ask


#: What shards give: answers to slices (``slice, shard, n, data``), frequent n-grams (``lang, word, ids, n``), and languages' sums (``lang, n``).
_GIVEN = "kind string, slice long, shard long, data binary, lang string, word string, ids array<long>, n long"
_GIVEN_TYPES = pa.schema([("kind", pa.string()), ("slice", pa.int64()), ("shard", pa.int64()), ("data", pa.binary()), ("lang", pa.string()),
                          ("word", pa.string()), ("ids", pa.list_(pa.int64())), ("n", pa.int64())])


def _given(kind: str, n_rows: int, **columns) -> pa.Table:
    columns["kind"] = [kind] * n_rows
    return pa.table([pa.nulls(n_rows, f.type) if f.name not in columns else columns[f.name] if isinstance(columns[f.name], pa.Array)
                     else pa.array(columns[f.name], f.type) for f in _GIVEN_TYPES], schema=_GIVEN_TYPES)


def _word_shard(least: int, bits: int):
    def add_up(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        names: dict[str, int] = {}
        spelled = [_spelled(row) for row in rows]
        lang = np.concatenate([np.array([names.setdefault(n, len(names)) for n in row["lang_names"]])[of]
                               for row, (_, of) in zip(rows, spelled, strict=True)])
        words = pa.concat_arrays([w for w, _ in spelled]).dictionary_encode()
        counts = np.concatenate([_read_small(row["counts"], row["n"]) for row in rows])
        pair, which = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(names) + lang, return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, which, counts)
        frequent = total >= least
        # dense over all shards, for hashing fills them evenly; from 1
        number = np.where(frequent, ((np.cumsum(frequent) - 1) << bits) + rows[0]["shard"] + 1, 0)
        kept, by_name = np.flatnonzero(frequent), list(names)
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, pair % len(names), total)
        answers = np.split(number[which], np.cumsum([row["n"] for row in rows])[:-1])
        spellings = words.dictionary.take(pa.array(pair[kept] // len(names))).cast(pa.large_string())
        return pa.concat_tables([
            _given("answer", len(rows), slice=[row["slice"] for row in rows], shard=[row["shard"] for row in rows],
                   data=[a.astype("<u4" if number.max() < 1 << 32 else "<u8").tobytes() for a in answers], n=[row["n"] for row in rows]),
            _given("gram", len(kept), lang=[by_name[i] for i in pair[kept] % len(names)], word=spellings.to_pylist(),
                   ids=[[i] for i in number[kept].tolist()], n=total[kept]),
            _given("sum", len(names), lang=by_name, n=sums)])
    return add_up


# ---- n-grams of ids

_IDS = "slice long, ids binary"


def _stretches(ids: np.ndarray, goes_on: np.ndarray, n: int) -> np.ndarray:
    """The ids of all stretches of n-grams that go on from one place to the next, each with a 0 behind."""
    first = np.flatnonzero(goes_on & ~np.append(False, goes_on[:-1]))
    last = np.flatnonzero(goes_on & ~np.append(goes_on[1:], False))
    size = last - first + n + 1
    upto = np.cumsum(size)
    if not len(size):
        return np.empty(0, ids.dtype)
    place = np.arange(upto[-1]) + np.repeat(first - (upto - size), size)
    found = ids[np.minimum(place, len(ids) - 1)]
    found[upto - 1] = 0
    return found


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places' ids from the answers to a slice's words."""
    for batch in batches:
        for row in batch.to_pylist():
            answers = sorted(row["answers"] or (), key=lambda a: a["shard"])
            known = [np.frombuffer(a["data"], "<u4" if len(a["data"]) == 4 * a["n"] else "<u8").astype(np.int64) for a in answers]
            ids = np.concatenate([np.zeros(1, np.int64), *known])[np.frombuffer(row["codes"], "<i4")]
            kept = _stretches(ids, ids > 0, 1)
            if len(kept):
                yield _id_row(row["slice"], kept)


def _id_row(number: int, ids: np.ndarray) -> pa.RecordBatch:
    width = "<u4" if int(ids.max()) < 1 << 32 else "<u8"
    return pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int64()),
                                       "ids": pa.array([width.encode() + ids.astype(width).tobytes()], pa.binary())})


def _read_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, data[:3].decode(), -1, 3).astype(np.int64)


def _grams(ids: np.ndarray, packing: Packing) -> tuple[np.ndarray, Filter, np.ndarray]:
    """Where n-grams begin, the filter of them, and each one's entry in it."""
    n = packing.n
    known = ids > 0
    at = np.flatnonzero(np.logical_and.reduce([known[i:len(ids) - n + 1 + i] for i in range(n)])) if len(ids) >= n else np.empty(0, np.int64)
    return at, *Filter.counted(packing, *packing.permuted(*packing.pack([ids[at + i] for i in range(n)])))


def _ask_grams(packing: Packing, shard_bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, counted, _ = _grams(_read_ids(row["ids"]), packing)
                shards, begins = counted.parts(shard_bits)
                for shard, a, b in zip(shards.tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([shard], pa.int64()), "slice": pa.array([row["slice"]], pa.int64()),
                        "data": pa.array([counted.write(a, b, shard_bits)], pa.binary())})
    return ask


def _gram_shard(packing: Packing, shard_bits: int, least: int):
    def add_up(asked: pa.Table) -> pa.Table:
        shards, numbers = asked.column("shard").to_pylist(), asked.column("slice").to_pylist()
        merged, entries = Filter.merged([Filter.read(packing, d, shards[0], shard_bits) for d in asked.column("data").to_pylist()])
        frequent = merged.counts >= least
        ids = packing.unpack(*packing.restored(merged.high[frequent], merged.low[frequent]))
        n = int(frequent.sum())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, packing.n * n + 1, packing.n), pa.int32()), pa.array(np.stack(ids, 1).ravel()))
        return pa.concat_tables([
            _given("answer", len(entries), slice=numbers, shard=shards, n=[len(e) for e in entries],
                   data=[np.packbits(frequent[e]).tobytes() for e in entries]),
            _given("gram", n, ids=lists, n=merged.counts[frequent])])
    return add_up


def _go_on(packing: Packing):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _read_ids(row["ids"])
                at, counted, entry = _grams(ids, packing)
                answers = sorted(row["answers"] or (), key=lambda a: a["shard"])
                frequent = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(a["data"], np.uint8), count=a["n"]) for a in answers)])
                goes_on = np.zeros(len(ids), bool)
                goes_on[at] = frequent.astype(bool)[entry]
                kept = _stretches(ids, goes_on, packing.n)
                if len(kept):
                    yield _id_row(row["slice"], kept)
    return cut


def _answers(given: DataFrame) -> DataFrame:
    return given.where("kind = 'answer'").groupBy("slice").agg(F.collect_list(F.struct("shard", "n", "data")).alias("answers"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                     longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that occur ``least`` times in texts of a language, and each language's words.

    First ``ids, n, lang, word``: a phrase as ids, which differ between languages, and its occurrences; ``lang`` and ``word`` are known of
    those of one word. Second ``lang, n``. Occurrences lie within pieces and may overlap.
    """
    if least < 1 or longest < 1:
        raise ValueError("least and longest: 1 or more")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG))
    table = written(docs.select(lang.alias("lang"), text_of(text_col).alias("text")).mapInArrow(_word_slices, _SLICE), "phrase-words", LARGE_ROWS)
    bits = _shard_bits(table.agg(F.sum("n")).first()[0] or 0)
    asked = table.drop("codes").mapInArrow(_ask_words(bits), "shard long, slice long, lang_names array<string>, n long, langs binary, "
                                                             "sizes binary, words binary, counts binary")
    given = written(asked.groupBy("shard").applyInArrow(_word_shard(least, bits), _GIVEN), "phrase-ids")
    sums = given.where("kind = 'sum'").groupBy("lang").agg(F.sum("n").alias("n"))
    grams = [given]
    most = given.where("kind = 'gram'").agg(F.max(F.col("ids")[0])).first()[0] or 0
    if longest > 1 and most:
        table = written(table.select("slice", "codes").join(_answers(given), "slice").mapInArrow(_with_ids, _IDS), "phrase-slices", LARGE_ROWS)
    for n in range(2, longest + 1 if most else 0):
        packing = Packing(n, int(most).bit_length())
        held = table.agg(F.sum(F.length("ids"))).first()[0] or 0
        shard_bits = min(packing.half, _shard_bits(held // 4))
        asked = table.mapInArrow(_ask_grams(packing, shard_bits), "shard long, slice long, data binary")
        given = written(asked.groupBy("shard").applyInArrow(_gram_shard(packing, shard_bits, least), _GIVEN), f"phrase-{n}")
        grams.append(given)
        if n < longest:
            table = written(table.join(_answers(given), "slice").mapInArrow(_go_on(packing), _IDS), f"phrase-slices-{n}", LARGE_ROWS)
    found = grams[0]
    for more in grams[1:]:
        found = found.unionByName(more)
    return found.where("kind = 'gram'").select("ids", "n", "lang", "word"), sums


def _cuts() -> Column:
    """The parts of a phrase cut after each word."""
    return F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda k: F.struct(
        k.alias("k"), F.slice("ids", F.lit(1), k).alias("first"), F.slice("ids", k + 1, F.size("ids") - k).alias("rest")))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of two words or more.

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs; a null text is
    empty, a null language ``und``. A phrase occurs ``a`` times (``least`` or more), its parts ``l`` and ``r`` times, the language's
    words ``n`` times; the cut is the one of least score floor(2000000 a / (l + r)), of several the first. A phrase gives way to
    a longer one that holds it and has 80 percent of its occurrences, whether that stays or not. Ranked by score, then ``a``,
    both falling, then by phrase in order of its UTF-8 bytes. Repeated rows count again; other columns play no part.
    """
    phrases, sums = frequent_phrases(docs, text_col, lang_col, least, longest)
    phrases = written(phrases, "phrases")
    counts, words = phrases.select("ids", "n"), phrases.where("word IS NOT NULL").select(F.col("ids")[0].alias("id"), "lang", "word")
    several = counts.where(F.size("ids") > 1).select("ids", F.col("n").alias("a"))

    within = (several.where(F.size("ids") > 2).select(F.col("a").alias("longer"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("ids") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.size("ids") - size + 1), lambda at: F.slice("ids", at, size))))).alias("ids"))
        .groupBy("ids").agg(F.max("longer").alias("longer")))

    def huge(c: Column) -> Column:
        return c.cast("decimal(20,0)")

    kept = several.join(within, "ids", "left").where(
        F.col("longer").isNull() | (huge(F.col("longer")) * 100 < huge(F.col("a")) * ABSORBS)).drop("longer")
    parts = kept.select("ids", "a", F.explode(_cuts()).alias("cut")).select("ids", "a", "cut.k", "cut.first", "cut.rest")
    scored = (parts.join(counts.select(F.col("ids").alias("first"), F.col("n").alias("l")), "first")
              .join(counts.select(F.col("ids").alias("rest"), F.col("n").alias("r")), "rest")
              .withColumn("score", F.expr(f"{SCALE} * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + r)"))
              .groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")))
    spelled = (scored.select("ids", "a", "best.score", "best.l", "best.r", F.posexplode("ids").alias("at", "id")).join(words, "id")
               .groupBy("ids", "a", "score", "l", "r", "lang")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
