"""Fill-in-the-middle transformation: a text is cut at two places and its parts are put in another order behind markers.

The bytes of many texts together become classes of characters in a wavelet matrix. Ranks of the classes that begin a unit add up to the
number of units before any byte, so both cuts of all texts are found by bisection on these counts, without decoding a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finfacts.llm.tokens import chunks
from finfacts.llm.wavelet import WaveletMatrix

#: Classes of bytes: inside a character, white space, line feed, first character of a word, other characters.
INSIDE, BLANK, LINE, WORD, REST = range(5)
LEVELS = 3
#: The classes whose bytes begin a unit.
UNITS: dict[str, tuple[int, ...]] = {"characters": (BLANK, LINE, WORD, REST), "words": (WORD,)}
#: Bytes of text in one wavelet matrix; one longer text has a matrix of its own.
TOGETHER = 2_000_000
MARKERS = ("<P>", "<S>", "<M>")
FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def byte_classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte of UTF-8 texts that lie one after the other and begin at starts."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    inside = (data & 0xC0) == 0x80
    classes = np.where(blank, np.where(data == 10, LINE, BLANK), np.where(inside, INSIDE, REST)).astype(np.uint8)
    after = np.concatenate([[True], blank[:-1]]) if len(data) else blank
    after[starts[starts < len(data)]] = True
    classes[after & (classes == REST)] = WORD
    return classes


def numbers(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a document; null counts as an id without digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; null counts as empty."""
    clean = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = clean.buffers()
    bounds = np.frombuffer(offsets, np.int64)[clean.offset: clean.offset + len(clean) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[bounds[0]:bounds[-1]], bounds - bounds[0]


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "characters", plain_percent: int = 10, spm_percent: int = 20,
                   markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of docs (columns doc_id and text are read).

    n counts the units of the text, code points or words; white space before a word belongs to the unit before it. The prefix ends after
    the smaller and the middle after the larger of two numbers of units drawn from seed and doc_id. form is plain (output is the text)
    for empty and null texts, texts that hold a marker, and plain_percent of the others; spm for spm_percent of what is left, else psm.
    prefix_chars and middle_chars count units and are null where plain. Rows that repeat a doc_id are each transformed; a null doc_id
    draws as an id without digits; very long texts are cut like others. An empty table gives no rows; further columns are not read.
    """
    marks = [m.encode() for m in markers]
    units = UNITS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for first, last in chunks(texts, TOGETHER):
                yield part(batch.column(0).slice(first, last - first), texts.slice(first, last - first))

    def part(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        data, bounds = _bytes_of(texts)
        starts, ends = bounds[:-1], bounds[1:]
        matrix = WaveletMatrix(byte_classes(data, starts), LEVELS)
        n = matrix.count(units, ends) - matrix.count(units, starts)
        drawn = np.array([numbers(seed, i) for i in ids.to_pylist()], np.int64).reshape(-1, 4)
        cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
        held = np.zeros(len(n), bool)
        for m in markers:
            held |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        plain = (starts == ends) | held | (drawn[:, 2] % 100 >= 100 - plain_percent)
        spm = drawn[:, 3] % 100 < spm_percent
        places = [np.where(c == 0, starts, matrix.locate(units, c, starts, ends)) for c in cuts.T]
        raw, outputs = data.tobytes(), []
        p, s, m = marks
        for a, x, y, b, as_is, back in zip(starts.tolist(), *(w.tolist() for w in places), ends.tolist(), plain.tolist(), spm.tolist(), strict=True):
            if as_is:
                outputs.append(raw[a:b])
            elif back:
                outputs.append(b"".join((s, raw[y:b], p, raw[a:x], m, raw[x:y])))
            else:
                outputs.append(b"".join((p, raw[a:x], s, raw[y:b], m, raw[x:y])))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        return pa.RecordBatch.from_arrays([
            ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(cuts[:, 0], pa.int64(), mask=plain),
            pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain), pa.array(outputs, pa.binary()).view(pa.string()),
        ], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FORMS)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that fill_in_middle made output of; no part holds a marker, so the first of each kind ends a part."""
    p, s, m = (rf"\Q{x}\E" for x in markers)
    return (F.when(form == "psm", F.regexp_replace(output, F.lit(rf"(?s)^{p}(.*?){s}(.*?){m}(.*)$"), F.lit("$1$3$2")))
            .when(form == "spm", F.regexp_replace(output, F.lit(rf"(?s)^{s}(.*?){p}(.*?){m}(.*)$"), F.lit("$2$3$1"))).otherwise(output))


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the sha256 of every output and of the text restored from it."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (length(t) + 1) AS x,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (length(t) + 1) AS y,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 AS plain,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 AS spm
  FROM texts
), parts AS (
  SELECT *, least(x, y) AS a, greatest(x, y) - least(x, y) AS m, substr(t, 1, least(x, y)) AS p,
    substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid, substr(t, greatest(x, y) + 1) AS s
  FROM drawn
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN m END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || mid ELSE '<P>' || p || '<S>' || s || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
