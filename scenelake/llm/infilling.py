"""Fill-in-the-middle documents: prefix, middle and suffix in the order that trains infilling, and back again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import arrow_rows, bounded_batches

#: What stands before the parts, and the shares (of 100) of documents in parts and of spm among these.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE, SEED = 50, 80, 42

#: Units: white space and the word behind it, or white space that no word follows. Possessive and atomic, as nothing is
#: ever given back, so the match keeps the ends of its units and no places to return to.
UNITS = r"((?>[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+))*+"


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers that follow from the id alone; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4]) for i in range(4))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every document; no shuffle.

    ``rate`` of 100 documents are cut at two unit ends, of which ``spm_rate`` of 100 put the suffix first (spm), the
    others the prefix (psm). The cuts and forms follow from the id and ``seed``, so reruns and lost tasks agree. Plain
    documents are their own text, with null prefix_chars and middle_chars: also empty texts and texts that contain one
    of the marks. Null texts are empty; rows that repeat an id draw alike and are cut each by its own text; an empty
    table gives no rows. A text is held in memory with the ends of its units.
    """
    bounded_batches(docs.sparkSession)
    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    names, types = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        units = regex.compile(UNITS)

        def cut(doc_id: int | None, text: str) -> tuple:
            ends = units.fullmatch(text).ends(1)
            n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
            if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                return doc_id, n, "plain", None, None, text
            low, high = (ends[i - 1] if i else 0 for i in sorted((h1 % (n + 1), h2 % (n + 1))))
            prefix, middle, suffix = text[:low], text[low:high], text[high:]
            if h4 % 100 < spm_rate:
                return doc_id, n, "spm", low, high - low, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
            return doc_id, n, "psm", low, high - low, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))

        for batch in batches:
            rows = [cut(k.as_py(), t.as_py()) for k, t in zip(batch.column(0), batch.column(1), strict=True)]
            yield arrow_rows(names, types, [list(c) for c in zip(*rows, strict=True)] or [[] for _ in names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, kind)


def restored(output: Column, form: Column) -> Column:
    """The text of a document from its output and form alone.

    The marks are found from left to right, which is safe: a cut text has none of them, and as no mark begins with the
    end of another, none can arise where a part meets a mark.
    """

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands after ``first`` at the start, after ``second`` and after the mark of the middle."""
        a = F.position(F.lit(second), output)
        b = F.position(F.lit(MIDDLE), output, a)
        start = F.lit(len(first) + 1)
        return (
            F.substr(output, start, a - start), F.substr(output, a + len(second), b - a - len(second)), F.substr(output, b + len(MIDDLE)),
        )

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
