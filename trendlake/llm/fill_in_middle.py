"""Fill-in-the-middle: a text is cut into units at zero-width boundaries, and its prefix, middle and suffix are put in another order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unit grammars: each boundary lies between a code point of the first class and one of the second. A word keeps the white space before it, a line its break. Low surrogates start no code point, so no pair of them is cut.
_SPACE = r"\x20\x09-\x0D"
UNITS: dict[str, tuple[tuple[str, str], ...]] = {
    "word": ((f"[^{_SPACE}]", f"[{_SPACE}]"),),
    "line": ((r"[\n]", r"[^\uDC00-\uDFFF]"),),
    "character": ((r"[\x00-\x{10FFFF}]", r"[^\uDC00-\uDFFF]"),),
    "sentence": ((r"[.!?。！？]", f"[{_SPACE}]"), (r"[。！？]", rf"[^{_SPACE}.!?。！？\uDC00-\uDFFF]")),
    "run": tuple((f"[{a}]", f"[^{a}]") for a in ("0-9", "A-Za-z", _SPACE)) + tuple((f"[^{a}]", f"[{a}]") for a in ("0-9", "A-Za-z", _SPACE)),
}
#: Fixed values of the contract: sentinels, and the shares of texts that are cut, and of those, that begin with the suffix.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE, SEED = 50, 80, 42


def boundary(unit: str) -> str:
    """The regular expression, of zero width, of a unit's boundaries: one look behind and one ahead for each pair of neighbouring classes."""
    return "|".join(f"(?<={left})(?={right})" for left, right in UNITS[unit])


def pieces(text: Column, unit: str) -> Column:
    """The units of a text, which joined are the text; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit)))


def transform(docs: DataFrame, unit: str = "word", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) with text (null: empty), n (units), form, prefix, middle, suffix (null where plain) and output.

    Where to cut follows from seed and doc_id alone, so reruns agree; a null doc_id counts as ''. `rate` percent of the texts are cut at two places, of these `spm_rate` percent begin with the suffix (spm), the others with the prefix (psm). Empty texts and such that hold a sentinel stay plain. Repeated rows give equal rows; further columns are left out. One pass, nothing is shuffled.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *(x.alias(f"h{k}") for k, x in enumerate(h)))
    plain = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (F.col("h2") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h3") % 100 < spm_rate, "spm").otherwise("psm")).withColumn("units", pieces(F.col("text"), unit))
    n = F.size("units")
    cut = [(F.col(f"h{k}") % (n + 1)).cast("int") for k in (0, 1)]
    rows = rows.withColumns({"n": n.cast("long"), "a": F.least(*cut), "b": F.greatest(*cut)})
    part = lambda first, count: F.when(F.col("form") != "plain", F.array_join(F.slice("units", first, count), ""))
    rows = rows.withColumns({"prefix": part(F.lit(1), F.col("a")), "middle": part(F.col("a") + 1, F.col("b") - F.col("a")), "suffix": part(F.col("b") + 1, n - F.col("b"))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.withColumn("output", output).select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. As a cut text holds no sentinel, the first of each kind is the one that was put in."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """What the query returns of transform()."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    chars = lambda c: F.char_length(c).cast("long")
    rows = transform(docs)
    return rows.select(
        "doc_id", "n", "form", chars(F.col("prefix")).alias("prefix_chars"), chars(F.col("middle")).alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
