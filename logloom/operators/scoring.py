"""Scores of many questions over Arrow batches of templates, the best ones kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logloom.functions.vectors import KEYWORD_WEIGHT, VECTOR_WEIGHT

ROWS = 512


def _matrix(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vector: row numbers and a matrix of doubles. Null vectors and those with a null are left out."""
    rows: dict[int, list[int]] = {}
    lengths = np.diff(vectors.offsets.to_numpy())
    for i in range(len(vectors)):
        value = vectors[i]
        if value.is_valid and value.values.null_count == 0:
            rows.setdefault(int(lengths[i]), []).append(i)
    return {
        n: (np.array(at), vectors.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), n))
        for n, at in rows.items()
    }


def _dots(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Dot products, summed element after element as Spark SQL does; masked where there is none."""
    found = np.ma.masked_all((len(left), len(right)), dtype=np.float64)
    others = _matrix(right)
    for n, (at, a) in _matrix(left).items():
        if n in others:
            to, b = others[n]
            total = np.zeros((len(at), len(to)))
            for d in range(n):
                total += np.multiply.outer(a[:, d], b[:, d])
            found[np.ix_(at, to)] = total
    return found


def _scores(rows: pa.Table, asked: pa.Table) -> np.ma.MaskedArray:
    def numbers(column: pa.ChunkedArray) -> np.ma.MaskedArray:
        whole = column.combine_chunks()
        return np.ma.MaskedArray(whole.fill_null(0.0).to_numpy(zero_copy_only=False), mask=whole.is_null().to_numpy(zero_copy_only=False))

    dots = _dots(rows["embedding"].combine_chunks(), asked["vector"].combine_chunks())
    norms = np.multiply.outer(numbers(rows["_norm"]).data, numbers(asked["_asked_norm"]).data)
    none = np.ma.getmaskarray(dots) | (norms == 0)
    similarity = np.divide(dots.data, norms, out=np.zeros(norms.shape), where=~none)
    words = [None if w is None else frozenset(w) for w in rows["_words"].to_pylist()]
    matched: dict[tuple, np.ndarray] = {}
    weight = np.zeros(norms.shape)
    for j, wanted in enumerate(asked["_wanted"].to_pylist()):
        if wanted:
            key = tuple(wanted)
            if key not in matched:
                need = frozenset(key)
                matched[key] = np.array([w is not None and need <= w for w in words], dtype=bool)
            weight[matched[key], j] = 1.0
    return np.ma.MaskedArray(VECTOR_WEIGHT * similarity + KEYWORD_WEIGHT * weight, mask=none)


def _best(scores: np.ma.MaskedArray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, question) of the best k rows of each question: NaN first, no score last, ties by `order`."""
    none, value = np.ma.getmaskarray(scores), scores.data
    kind = np.where(none, 0, np.where(np.isnan(value), 2, 1))
    key = np.where(kind == 1, value, np.where(kind == 2, np.inf, -np.inf))
    cut = max(0, key.shape[0] - k)
    question, row = np.nonzero((key >= np.partition(key, cut, axis=0)[cut]).T)
    sort = np.lexsort((order[row], -key[row, question], -kind[row, question], question))
    row, question = row[sort], question[sort]
    place = np.arange(len(question)) - np.searchsorted(question, question)
    return row[place < k], question[place < k]


def best_rows(ready: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(question_id, tenant_id, template_id, score): per question the best k of every few hundred templates of its tenant.

    `asked` goes to the driver and to all workers; the caller knows that it is small.
    """
    fields = [asked.schema["question_id"], ready.schema["tenant_id"], ready.schema["template_id"]]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    sink = pa.BufferOutputStream()
    table = asked.toArrow()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    sent = sink.getvalue().to_pybytes()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = pa.ipc.open_stream(sent).read_all()
        tenants: dict = {}
        for i, tenant in enumerate(questions["tenant_id"].to_pylist()):
            tenants.setdefault(tenant, []).append(i)
        tenants.pop(None, None)
        mine = {tenant: questions.take(pa.array(at)) for tenant, at in tenants.items()}
        for batch in batches:
            places: dict = {}
            for i, tenant in enumerate(batch.column("tenant_id").to_pylist()):
                if tenant in mine:
                    places.setdefault(tenant, []).append(i)
            for tenant, at in places.items():
                for first in range(0, len(at), ROWS):
                    rows = pa.Table.from_batches([batch.take(pa.array(at[first:first + ROWS]))])
                    ids = [(x is not None, (x or "").encode()) for x in rows["template_id"].to_pylist()]
                    order = np.empty(len(ids), dtype=np.int64)
                    order[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
                    for start in range(0, len(mine[tenant]), ROWS):
                        part = mine[tenant].slice(start, ROWS)
                        scores = _scores(rows, part)
                        row, question = _best(scores, order, k)
                        values = scores[row, question]
                        yield pa.RecordBatch.from_arrays([
                            part["question_id"].combine_chunks().take(pa.array(question)),
                            rows["tenant_id"].combine_chunks().take(pa.array(row)),
                            rows["template_id"].combine_chunks().take(pa.array(row)),
                            pa.array(values.data, mask=np.ma.getmaskarray(values), type=pa.float64()),
                        ], names=[f.name for f in schema.fields])

    return ready.mapInArrow(score, schema)
