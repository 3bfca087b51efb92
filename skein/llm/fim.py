"""Fill-in-the-middle transformation, in DataFrame functions only.

A text is cut into lines (``[^\\n]*\\n|[^\\n]+``: each with its newline, the last
perhaps without). A hash of the seed and the document's id gives four numbers;
the first two are the cuts, the third decides whether the text is arranged at
all, the fourth in which order. Arrangements are

- ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
- ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle,
- ``plain``: the text as it is.

A text that is empty or that holds one of the three marks stays plain, so an
arranged output holds each mark once and the text comes back by splitting at
the marks. (No piece can complete a mark across a border: each mark has its
only ``<`` at its start.)

Defined results: a null text is empty; a null id is hashed as an empty string;
rows that share an id are arranged by the same numbers; repeated rows each give
a row; other columns stay as they are, and those named like a result are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = r"[^\n]*\n|[^\n]+"
ANY_MARK = "<[PSM]>"

#: Production parameters: the seed, the share of texts that are arranged, and of these the share in spm order, in percent.
SEED, RATE, SPM_RATE = 7, 100, 50


def _number(digest: Column, place: int) -> Column:
    """The ``place``-th group of eight hexadecimal digits (from 1) as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * place - 7, 8), 16, 10).cast("long")


def _joined(units: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(units, start, count), "")


def arrange(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``output``, and code points of ``prefix_chars`` and ``middle_chars`` (null if plain)."""
    common.extra(docs, ("doc_id", "text"))
    results = ("n", "form", "output", "prefix_chars", "middle_chars")
    kept = [c for c in docs.columns if c.lower() not in (*results, "text")]
    row = F.struct(*(docs[c] for c in kept)).alias("row")  # one column: no name of ours meets one of theirs
    text = F.coalesce(docs["text"], F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 256)
    cut = docs.select(row, text.alias("text"), digest.alias("digest"), F.regexp_extract_all(text, F.lit(UNITS), 0).alias("units"))
    cut = cut.withColumn("n", F.size("units").cast("long"))
    a, b = _number(F.col("digest"), 1) % (F.col("n") + 1), _number(F.col("digest"), 2) % (F.col("n") + 1)
    plain = (F.col("text") == "") | F.rlike("text", F.lit(ANY_MARK)) | (_number(F.col("digest"), 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_number(F.col("digest"), 4) % 100 < spm_rate, "spm").otherwise("psm")
    cut = cut.select("row", "text", "units", "n", F.least(a, b).cast("int").alias("one"), F.greatest(a, b).cast("int").alias("two"), form.alias("form"))
    units, one, two = F.col("units"), F.col("one"), F.col("two")
    parts = F.struct(_joined(units, F.lit(1), one).alias("prefix"), _joined(units, one + 1, two - one).alias("middle"), _joined(units, two + 1, F.col("n").cast("int") - two).alias("suffix"))
    cut = cut.select("row", "text", "n", "form", F.when(F.col("form") != "plain", parts).alias("p"))
    mark = {m: F.lit(m) for m in (PREFIX, SUFFIX, MIDDLE)}
    output = (
        F.when(F.col("form") == "psm", F.concat(mark[PREFIX], "p.prefix", mark[SUFFIX], "p.suffix", mark[MIDDLE], "p.middle"))
        .when(F.col("form") == "spm", F.concat(mark[SUFFIX], "p.suffix", mark[PREFIX], "p.prefix", mark[MIDDLE], "p.middle"))
        .otherwise(F.col("text"))
    )
    return cut.select(
        "row.*", "n", "form", output.alias("output"),
        F.length("p.prefix").cast("long").alias("prefix_chars"), F.length("p.middle").cast("long").alias("middle_chars"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone."""
    part = F.split(output, ANY_MARK, -1)
    return (
        F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))))
        .when(form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1))))
        .otherwise(output)
    )


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    done = arrange(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units,
    sha256('7:' || coalesce(cast(doc_id as varchar), '')) as digest from documents
), numbered as (
  select *, cast(len(units) as bigint) as n, cast('0x' || substr(digest, 1, 8) as bigint) as h1, cast('0x' || substr(digest, 9, 8) as bigint) as h2,
    cast('0x' || substr(digest, 17, 8) as bigint) as h3, cast('0x' || substr(digest, 25, 8) as bigint) as h4 from cut
), placed as (
  select doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) as one, greatest(h1 % (n + 1), h2 % (n + 1)) as two,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form from numbered
), parts as (
  select *, array_to_string(list_slice(units, 1, one), '') as prefix, array_to_string(list_slice(units, one + 1, two), '') as middle,
    array_to_string(list_slice(units, two + 1, n), '') as suffix from placed
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
