"""Fill-in-the-middle examples: a text's prefix, middle and suffix in another order, each text cut at places drawn by its id.

Texts go to Python as Arrow batches of a pandas UDF. One pass of ``finditer`` over a text collects the ends of its units in a
compact array of 32-bit numbers; the two cuts are then two lookups in it and slices of the text, so time and memory are linear
in the text. Seeds and digests are hashlib's. A row needs no other row, so there is no shuffle and no skew.

A unit is a run of white space with the word after it, or white space that ends the text. Three sentinels mark the parts; a
text that holds one of them stays as it is, and since no sentinel begins with what another one ends with, a part and the
sentinel after it form no third one: the first sentinel found is always the one that was put there, and ``restore`` is exact.

Defined results: a null text is empty, and empty texts stay plain, with no units; a null id counts as the empty text; repeated rows each get the
same result; texts of any length are cut whole; columns of the input named like an added one are replaced; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table, whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Possessive, so a long run of white space at a text's end is looked at once.
UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def draws(seed: int, key: str) -> list[int]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def restore(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (SUFFIX, MIDDLE) if form == "psm" else (PREFIX, MIDDLE)
    a, _, rest = output[len(PREFIX) :].partition(first)
    b, _, middle = rest.partition(second)
    return a + middle + b if form == "psm" else b + middle + a


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def arrange(key: str, text: str, seed: int, rate: int, spm: int) -> tuple:
    """n, form, prefix_chars, middle_chars and the output of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[low - 1] if low else 0), (ends[high - 1] if high else 0)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80, outputs: bool = True) -> DataFrame:
    """docs with the columns of ``ADDED``: of 100 texts about ``rate`` are cut, and of 100 of these about ``spm`` have the suffix first.

    Without ``outputs`` the column output is null and only its digest leaves the task.
    """

    @F.pandas_udf(ADDED)
    def cut(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for k, t in zip(keys, texts, strict=True):
            *head, output = arrange(k, t, seed, rate, spm)
            rows.append((*head, output if outputs else None, _sha256(output), _sha256(restore(output, head[1]))))
        done = pd.DataFrame(rows, columns=[c.split()[0] for c in ADDED.split(", ")])
        return done.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    made = cut(F.coalesce(F.col(key).cast("string"), F.lit("")), whole_text(text))
    names = [c.split()[0] for c in ADDED.split(", ")]
    clash = {n.lower() for n in names}
    free = "_cut"
    while free in docs.columns:
        free += "_"
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in clash]
    return docs.withColumn(free, made).select(*kept, *[F.col(f"{free}.{n}") for n in names])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle(docs, outputs=False).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: The text restored is the text itself.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
