"""Arrow batches of texts: inverted indexes and counts of n-grams, without a row for each token."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame

#: Letters of the texts that are worked on at once, and rows of a batch that is given back.
LETTERS, ROWS = 16_000_000, 500_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package


def pieces(batches: Iterable[pa.RecordBatch], column: int, letters: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose texts have so many letters in all, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + letters, "right")))
            yield batch.slice(at, end - at)
            at = end


def encoded(clean: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of each word of cleaned texts and the words by code; an empty text has none."""
    lists = pc.split_pattern(clean, " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    rows, codes = np.repeat(np.arange(len(sizes)), sizes), words.indices.to_numpy().astype(np.int64)
    said = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[codes]
    return rows[said], codes[said], words.dictionary


def inverted_index(texts: DataFrame, clean: str, name: str, letters: int = LETTERS) -> DataFrame:
    """``texts`` with the map ``name`` (word -> positions, ascending) in place of the cleaned text.

    Each text is indexed where it is: no token is shuffled or sorted by Spark.
    """
    column = texts.columns.index(clean)
    rest = [c for c in texts.columns if c != clean]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column, letters):
            rows, codes, words = encoded(batch.column(column))
            places = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keys = rows * max(1, len(words)) + codes
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), pa.array(places[order], pa.int32()))
            ends = np.searchsorted(rows[order[starts]], np.arange(batch.num_rows + 1))
            index = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(codes[order[starts]])), lists)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns) if i != column], index], [*rest, name])

    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in rest)
    return texts.mapInArrow(run, f"{fields}, `{name}` map<string, array<int>>")


def counter(low: int, high: int, stop_words: Iterable[str] = (), lemmas: Broadcast[dict[str, str]] | None = None, letters: int = LETTERS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function from (publication_year, n, clean) to (ngram, publication_year, count, words), counted within each piece.

    Rows of a null n-gram count the texts of a year and sum up their ``n``.
    """
    stops = pa.array(sorted(stop_words), pa.string())

    def of(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        years = batch.column(0).dictionary_encode()
        of_row = years.indices.fill_null(len(years.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        width = len(years.dictionary) + 1
        texts, sums = np.bincount(of_row, minlength=width), np.bincount(of_row, batch.column(1).to_numpy(zero_copy_only=False), width).astype(np.int64)
        some = np.flatnonzero(texts)
        named = lambda at: years.dictionary.take(pa.array(at, mask=at == width - 1))
        yield [pa.nulls(len(some), pa.string()), named(some), pa.array(texts[some]), pa.array(sums[some])]
        rows, codes, words = encoded(batch.column(2))
        if lemmas:
            get = lemmas.value.get
            named_words = pa.array([get(w, w) for w in words.to_pylist()], pa.string()).dictionary_encode()
            codes, words = named_words.indices.to_numpy().astype(np.int64)[codes], named_words.dictionary
        if len(stops):
            kept = ~pc.is_in(words, stops).to_numpy(zero_copy_only=False)[codes]
            rows, codes = rows[kept], codes[kept]
        at, grams = np.arange(len(codes)), np.zeros(len(codes), np.int64)  # where a run begins, and the number of the run so far
        for n in range(1, high + 1):
            if n > 1:
                fits = at + n - 1 < len(rows)
                at, grams = at[fits], grams[fits]
                fits = rows[at] == rows[at + n - 1]
                at, grams = at[fits], grams[fits]
            if not len(at):
                return
            keys = (grams * len(words) + codes[at + n - 1]) * width + of_row[rows[at]]
            order = np.argsort(keys)
            keys = keys[order]
            if n >= low:
                starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                counts, first = np.diff(np.append(starts, len(keys))), at[order[starts]]
                for i in range(0, len(first), ROWS):
                    own = first[i : i + ROWS]
                    made = [words.take(pa.array(codes[own + k])) for k in range(n)]
                    ngram = pc.binary_join_element_wise(*made, " ") if n > 1 else made[0]
                    yield [ngram, named(of_row[rows[own]]), pa.array(counts[i : i + ROWS], pa.int64()), pa.nulls(len(own), pa.int64())]
            if n < high:
                keys //= width
                grams[order] = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, letters):
            for columns in of(batch):
                yield pa.RecordBatch.from_arrays(columns, ["ngram", "publication_year", "count", "words"])

    return run
