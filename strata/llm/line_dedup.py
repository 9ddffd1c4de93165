"""Line dedup: overlapping three-line windows, repeated windows found globally.

Windows run over the non-blank lines of a text (split at ``\\n``, outer ASCII white space of a
line ignored), so a text of n such lines has n - 2 windows. Each window is a 128-bit digest.
The first occurrence of a window is the smallest (doc_id, row key, position) over the whole
table; every other occurrence is removed: the positions that its lines cover are merged per
document and those lines go, with the blank lines between them. Every distinct line that is
removed somewhere stays at an earlier place.

Shuffles: the windows twice (a combined minimum per window, the join back), the texts once.

Defined cases: null texts stay null and empty ones empty; texts of fewer than three
non-blank lines have no window and stay as they are; rows with the same id and text count as
one document and get the same result; rows that share only their id are told apart by their
text; null ids sort first; an empty table gives no row. The operator reads ``doc_id`` and
``text`` and carries all other columns along; its own two columns have reserved names.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import common
from strata.llm.kernels import Words, sequence_hashes, slices, span_hashes

WINDOW = 3
_BLANK = " \t\n\x0b\x0c\r"


def _lines(raw: np.ndarray, offsets: np.ndarray):
    """Start, end and text row of every non-blank line of a slice, stripped."""
    words = Words(raw, offsets)
    if not len(words.start):
        return words.start, words.end, words.row
    line = np.cumsum(raw == 10)[words.start] + words.row
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    return words.start[first], words.end[np.append(first[1:], len(line)) - 1], words.row[first]


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(k1, k2, doc_id, row key, position) of every window of ``size`` non-blank lines."""
    keyed = common.with_row_key(docs.select("doc_id", "text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column(common.ROW_KEY)
            for at, _, raw, offsets in slices(batch.column("text")):
                start, end, row = _lines(raw, offsets)
                if len(start) < size:
                    continue
                whole = row[: len(row) - size + 1] == row[size - 1:]
                position = np.arange(len(row)) - np.searchsorted(row, row)
                k1, k2 = (sequence_hashes(span_hashes(raw, start, end, t), size)[whole].view(np.int64) for t in (0, 1))
                row = pa.array(row[: len(whole)][whole] + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1), pa.array(k2), ids.take(row), keys.take(row), pa.array(position[: len(whole)][whole].astype(np.int32))],
                    ["k1", "k2", "doc_id", common.ROW_KEY, "position"])

    return keyed.mapInArrow(run, f"k1 long, k2 long, doc_id {id_type}, {common.ROW_KEY} long, position int")


def repeated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, row key, places): per document the positions of its windows that occur earlier."""
    later = common.later_occurrences(windows(docs, size), ["k1", "k2"], ["doc_id", common.ROW_KEY, "position"])
    # One value per window of one document: bounded by that document's own lines.
    return later.groupBy("doc_id", common.ROW_KEY).agg(F.collect_set("position").alias(common.PLACES))


def _strip(text: str, places: list[int], size: int) -> tuple[str, int, int]:
    """Text without the covered lines, its number of non-blank lines, and how many of them went."""
    lines = text.split("\n")
    solid = [i for i, line in enumerate(lines) if line.strip(_BLANK)]
    gone, until = np.zeros(len(lines), bool), -1
    for p in sorted(places):
        first, last = solid[p], solid[p + size - 1]
        gone[max(first, until):last + 1] = True
        until = max(until, last + 1)
    return "\n".join(line for line, out in zip(lines, gone) if not out), len(solid), int(gone[solid].sum())


def dedup_lines(docs: DataFrame, size: int = WINDOW, counts: bool = False) -> DataFrame:
    """``docs`` with the repeated windows cut out of ``text``.

    With ``counts``, two more columns: ``n_lines`` (non-blank lines) and ``n_removed``.
    """
    common.bound_batches(docs.sparkSession)
    joined = common.attach_places(common.with_row_key(docs), repeated(docs, size))
    at = docs.columns.index("text")
    schema = T.StructType(docs.schema.fields + [T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType())] * counts)

    def run(batches):
        for batch in batches:
            texts, places = batch.column(at), batch.column(batch.num_columns - 1)
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            cut = {i: _strip(texts[i].as_py(), places[i].as_py(), size) for i in np.flatnonzero(places.is_valid().to_numpy(False))}
            if cut:
                columns[at] = pa.array([cut[i][0] if i in cut else texts[i].as_py() for i in range(len(texts))], texts.type)
            if counts:
                n_lines = np.zeros(len(texts), np.int32)
                for first, stop, raw, offsets in slices(texts):
                    n_lines[first:stop] = np.bincount(_lines(raw, offsets)[2], minlength=stop - first)
                columns += [pa.array(n_lines), pa.array([cut[i][2] if i in cut else 0 for i in range(len(texts))], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.documents(spark, sf_dir).select("doc_id", "text"), counts=True)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated windows removed and ``n_chars`` of the new text; every row stays."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, ln, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln
        FROM documents)
), solid AS (
  SELECT doc_id, ln, body, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos FROM lines WHERE body <> ''
), wins AS (
  SELECT doc_id, pos, ln AS a, lead(ln, 2) OVER w AS z, body AS b0, lead(body) OVER w AS b1, lead(body, 2) OVER w AS b2
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, a, z FROM (
    SELECT doc_id, a, z, row_number() OVER (PARTITION BY b0, b1, b2 ORDER BY doc_id, pos) AS nth FROM wins WHERE z IS NOT NULL)
  WHERE nth > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.ln FROM lines l JOIN later w ON l.doc_id = w.doc_id AND l.ln BETWEEN w.a AND w.z
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE g.ln IS NULL) AS text,
         count(*) FILTER (WHERE l.body <> '') AS n_lines, count(*) FILTER (WHERE l.body <> '' AND g.ln IS NOT NULL) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.ln = g.ln GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
