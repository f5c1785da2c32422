"""Lines of growing sources, from chunks of text that may end in the middle of a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.sources.lines import MAX_BROADCAST_BLOCKS

CHUNKS = "source STRING, chunk STRING, text STRING"
# ``last`` is the newest chunk of the source so far; one that comes after it must have a later name.
TAILS = "source STRING, lines BIGINT, tail STRING, last STRING"

LINE_END = r"\r\n|\r|\n"
# Lines of a chunk that comes too late would be glued to the wrong ones, so the run stops instead.
LATE_CHUNK = "cast(raise_error(concat('chunk ', chunk, ' of ', source, ' came after ', last)) AS BOOLEAN)"


def follow_chunks(spark: SparkSession, landing: str, *, max_files: int = 1000) -> DataFrame:
    """Stream of ``source, chunk, text`` from chunk files shipped to ``landing/<source>/<chunk>``.

    Spark takes a file as finished once it appears, so a growing log arrives as a row of chunk
    files, in the order of their names. ``max_files`` bounds what one trigger takes in.
    """
    stream = spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true")
    path = F.col("_metadata.file_path")
    return stream.text(landing, wholetext=True).select(
        F.url_decode(F.replace(F.element_at(F.split(path, "/"), -2), F.lit("+"), F.lit("%2B"))).alias("source"),
        F.element_at(F.split(path, "/"), -1).alias("chunk"),
        F.col("value").alias("text"),
    )


# Each chunk, and before those of a source what is left of it: the pieces between its line ends.
_CUT = rf"""
WITH cut AS (
  SELECT source, chunk, seen, last, endswith(text, '\r') AS cr, startswith(text, '\n') AS lf,
    split(if(endswith(text, '\r'), left(text, length(text) - 1), text), r'{LINE_END}', -1) AS pieces
  FROM {{texts}}
),"""
# A carriage return at the end of a chunk ends a line unless a line feed follows; with no chunk after it, that is still open.
# ``before`` and ``total`` count the lines of the source before the chunk and after the batch.
_FACTS = rf"""
ends AS (
  SELECT *, cr AND coalesce(NOT next_lf, false) AS ends, cr AND next_lf IS NULL AS open, n - 1 + cast(cr AND coalesce(NOT next_lf, false) AS INT) AS line_ends
  FROM (
    SELECT source, chunk, cr, size(pieces) AS n, pieces[0] AS head, element_at(pieces, -1) AS foot,
      lead(lf) OVER (PARTITION BY source ORDER BY chunk) AS next_lf,
      coalesce(max(seen) OVER (PARTITION BY source), 0L) AS seen, max(last) OVER (PARTITION BY source) AS last
    FROM cut
  )
), facts AS (
  SELECT source, chunk, n, head, if(ends, '', if(open, concat(foot, '\r'), foot)) AS foot, line_ends,
    if(chunk <> '' AND chunk <= last, {LATE_CHUNK}, ends) AS ends,
    greatest(nullif(max(chunk) OVER (PARTITION BY source), ''), last) AS newest,
    seen + coalesce(sum(line_ends) OVER (PARTITION BY source ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before,
    seen + sum(line_ends) OVER (PARTITION BY source) AS total
  FROM ends
)"""
_JOINED = "array_join(transform(array_sort(collect_list({})), x -> x.value), '')"
# The first and last piece of a chunk meet others where a line goes on; they are dealt by source already.
_LINES = f"""{_CUT}{_FACTS}
SELECT source, line_no, {_JOINED.format("struct(chunk, value)")} AS value
FROM (
  SELECT source, chunk, total, inline(if(n = 1 AND NOT ends, array(named_struct('line_no', before + 1, 'value', foot)),
    array(named_struct('line_no', before + 1, 'value', head), named_struct('line_no', before + n + cast(ends AS INT), 'value', foot))))
  FROM facts
) WHERE line_no <= total GROUP BY source, line_no
UNION ALL
SELECT source, before + nth + 2 AS line_no, value
FROM (
  SELECT source, before, posexplode(slice(pieces, 2, greatest(size(pieces) - if(ends, 1, 2), 0))) AS (nth, value)
  FROM (SELECT source, chunk, pieces FROM cut WHERE size(pieces) > 1) JOIN (SELECT source, chunk, before, ends FROM facts WHERE n > 1) USING (source, chunk)
)"""
# Of the chunks behind whose end no line ends, what is behind their own last line end.
_LEFT = f"""{_CUT}{_FACTS}
SELECT source, max(total) AS lines,
  {_JOINED.format("if(before + line_ends = total, named_struct('chunk', chunk, 'value', if(ends, '', foot)), NULL)")} AS tail, max(newest) AS last
FROM facts GROUP BY source"""


def assemble_partial_lines(chunks: DataFrame, tails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete lines of one batch of chunks, and what is left of each source for the next.

    ``tails`` holds, per source, the lines so far and the unfinished last one. Pieces between
    two line ends inside one chunk pass straight through; only the first and last piece of a
    chunk meet others, by source. A chunk whose name is not after those of earlier
    batches raises an error. The order of chunks is settled on one small
    row per chunk, so a busy source is not pulled into one task. The plans are short, as small batches mostly wait for them:
    the lines move the small rows once and the chunks meet them, the tails are one shuffle of small rows.
    """
    texts = chunks.where("text <> '' AND source IS NOT NULL AND chunk IS NOT NULL").selectExpr("source", "chunk", "text", "cast(NULL AS BIGINT) AS seen", "cast(NULL AS STRING) AS last")
    texts = texts.unionByName(tails.selectExpr("source", "'' AS chunk", "tail AS text", "lines AS seen", "last"))
    return tuple(texts.sparkSession.sql(query, texts=texts) for query in (_LINES, _LEFT))


def arrival_order(lines: DataFrame, sources: DataFrame, base: int) -> DataFrame:
    """Lines of one batch with ``source_idx``, ``format`` and ``pos``.

    ``pos`` counts on from ``base``, the last place of the batches before: sources in their order,
    each source's lines in theirs; ``sources`` has every source of ``lines``. Only one row per source is ordered globally,
    and goes to the lines, so the lines of a busy source stay spread over tasks.
    """
    span = F.max("line_no") - F.min("line_no") + 1
    counted = lines.groupBy("source").agg(F.min("line_no").alias("first_no"), span.alias("n"))
    offsets = counted.join(sources.select("source", "source_idx", "format"), "source").selectExpr(
        "source",
        "source_idx",
        "format",
        "coalesce(sum(n) OVER (ORDER BY source_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) "
        "- first_no + 1 AS shift",
    )
    if sources.count() <= MAX_BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    return lines.join(offsets, "source").selectExpr(
        "source", "source_idx", "line_no", "value", "format", f"{base}L + line_no + shift AS pos"
    )
