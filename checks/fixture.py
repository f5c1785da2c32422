"""Log lines written from the ``events`` table, with the same text in Spark SQL and DuckDB.

Event times are packed a thousandfold, so that bursts occur. About one event in ten is
unusual in some way: another offset, no address, a bad stamp, a blank or broken line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logwarden.session import HUGE_METHOD, scratch_path

YEAR = 2024

_SPARK = {
    "@ES": "(1704067200 + (unix_micros(cast(ts AS TIMESTAMP)) - 1704067200000000) div 1000000000)",
    "@WEB_STAMP": "date_format(timestamp_seconds(es), 'dd/MMM/yyyy:HH:mm:ss')",
    "@EAST_STAMP": "date_format(timestamp_seconds(es + 7200), 'dd/MMM/yyyy:HH:mm:ss')",
    "@AUTH_STAMP": "date_format(timestamp_seconds(es), 'MMM dd HH:mm:ss')",
    "@SHORT_STAMP": "date_format(timestamp_seconds(es), 'MMM d HH:mm:ss')",
    "@DIV": "div",
}
_DUCK = {
    "@ES": "(1704067200 + (epoch_us(ts) - 1704067200000000) // 1000000000)",
    "@WEB_STAMP": "strftime(make_timestamp(es * 1000000), '%d/%b/%Y:%H:%M:%S')",
    "@EAST_STAMP": "strftime(make_timestamp((es + 7200) * 1000000), '%d/%b/%Y:%H:%M:%S')",
    "@AUTH_STAMP": "strftime(make_timestamp(es * 1000000), '%b %d %H:%M:%S')",
    "@SHORT_STAMP": "strftime(make_timestamp(es * 1000000), '%b %-d %H:%M:%S')",
    "@DIV": "//",
}

# One row per event: event_id, es (epoch second), format, value (the line).
_LINES = """
SELECT event_id, es, format,
  CASE
    WHEN event_id % 101 = 0 THEN '   '
    WHEN event_id % 97 = 0 THEN '[MALFORMED ENTRY ' || event_id
    WHEN format = 'web' THEN
      CASE WHEN event_id % 29 = 0 THEN '-' WHEN event_id % 31 = 0 THEN '2001:db8::' || (user_id % 12)
           ELSE '10.0.0.' || (user_id % 12) END
      || CASE WHEN event_id % 7 = 0 THEN ' id' || (event_id % 3) || ' u' || user_id ELSE ' - -' END
      || ' ['
      || CASE WHEN event_id % 53 = 0 THEN '32/Jan/2024:00:00:00 +0000'
              WHEN event_id % 59 = 0 THEN @WEB_STAMP
              WHEN event_id % 37 = 0 THEN @EAST_STAMP || ' +0200'
              ELSE @WEB_STAMP || ' +0000' END
      || '] "'
      || CASE event_id % 16
           WHEN 0 THEN 'GET /login HTTP/1.1'
           WHEN 1 THEN 'GET /p' || (event_id % 50) || ' HTTP/1.1'
           WHEN 2 THEN 'GET /p' || (event_id % 50) || '/?x=1 HTTP/1.1'
           WHEN 3 THEN 'GET /s?q=1%20union%20select%20x HTTP/1.1'
           WHEN 4 THEN 'GET /f/%252e%252e%252fetc HTTP/1.1'
           WHEN 5 THEN 'GET /.env HTTP/1.1'
           WHEN 6 THEN 'GET /s?q=%3Cscript%3Ealert(1)%3C/script%3E HTTP/1.1'
           WHEN 7 THEN 'POST /login?next=/home HTTP/1.1'
           WHEN 8 THEN 'GET  /a  b c HTTP/1.1'
           WHEN 9 THEN 'GARBAGE'
           WHEN 10 THEN ''
           WHEN 11 THEN 'GET /two'
           WHEN 12 THEN 'GET /p' || (event_id % 50) || '// HTTP/1.1'
           WHEN 13 THEN 'GET /q?a=%zz%41+b HTTP/1.1'
           WHEN 14 THEN 'GET /admin/../etc/passwd HTTP/1.1'
           ELSE 'GET /home HTTP/1.1' END
      || '" '
      || CASE WHEN event_id % 41 = 0 THEN '-'
              WHEN event_id % 16 = 0 THEN '401' WHEN event_id % 16 = 7 THEN '403'
              WHEN event_id % 16 IN (1, 2, 12) THEN '404' ELSE '200' END
      || ' ' || CASE WHEN event_id % 43 = 0 THEN '-' ELSE '' || (event_id % 1000) END
      || CASE event_id % 11
           WHEN 0 THEN ' "-" "sqlmap/1.7"'
           WHEN 1 THEN ' "-" "-"'
           WHEN 2 THEN ''
           WHEN 3 THEN ' "http://ref/' || (event_id % 5) || '" "Mozilla/5.0 Nikto/2.1"'
           WHEN 4 THEN ' "" ""'
           ELSE ' "-" "Mozilla/5.0"' END
    ELSE
      CASE WHEN event_id % 53 = 0 THEN 'Feb 30 10:00:00' WHEN event_id % 2 = 0 THEN @AUTH_STAMP
           ELSE @SHORT_STAMP END
      || ' host' || (event_id % 3)
      || CASE WHEN event_id % 13 = 0 THEN ' sudo: ' ELSE ' sshd[' || (1000 + event_id % 500) || ']: ' END
      || CASE
           WHEN event_id % 13 = 0
             THEN 'alice : TTY=pts/0 ; PWD=/root ; USER=root ; COMMAND=/bin/cat /etc/shadow'
           WHEN event_id % 17 = 0
             THEN 'Connection closed by 10.0.0.' || (user_id % 12) || ' port ' || (1024 + event_id % 1000) || ' [preauth]'
           WHEN event_id % 19 = 0
             THEN 'Failed none for invalid user guest' || (event_id % 5) || ' from 10.0.0.' || (user_id % 12)
                  || ' port 22 ssh2'
           WHEN event_type = 'error'
             THEN 'Failed password for ' || CASE WHEN event_id % 3 = 0 THEN 'invalid user ' ELSE '' END
                  || 'u' || user_id || ' from 10.0.0.' || (user_id % 12) || ' port ' || (1024 + event_id % 1000) || ' ssh2'
           ELSE 'Accepted ' || CASE WHEN event_id % 2 = 0 THEN 'publickey' ELSE 'password' END
                || ' for u' || user_id || ' from 10.0.0.' || (user_id % 12)
                || CASE WHEN event_id % 5 = 0 THEN '' ELSE ' port ' || (1024 + event_id % 1000) END
         END
  END AS value
FROM (
  SELECT event_id, user_id, event_type, @ES AS es,
    CASE WHEN event_type IN ('error', 'signup') THEN 'auth' ELSE 'web' END AS format
  FROM events
) AS e
"""

# Three sources, read one after another; the third is late with respect to the second.
_RUN = """
SELECT *, CASE source WHEN '/var/log/web.log' THEN 0 WHEN '/a/auth.log' THEN 1 ELSE 2 END AS source_idx,
  event_id + 1 AS line_no
FROM (
  SELECT *, CASE WHEN format = 'web' THEN '/var/log/web.log' WHEN event_id % 10 = 3 THEN '/b/auth.log'
                 ELSE '/a/auth.log' END AS source
  FROM (@LINES) AS l
) AS s
"""

# Rotated files of at most 4000 events each, with gapless line numbers.
FILE_EVENTS = 4000
_FILES = f"""
SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_id) AS line_no
FROM (SELECT *, format || '-' || (1000 + event_id @DIV {FILE_EVENTS}) || '.log' AS source FROM (@LINES) AS l) AS s
"""

# Sixty sources to tell the format of: web, auth, junk, and some that begin with junk.
_MIXED = """
SELECT event_id, source, source_idx, line_no, format AS true_format, es,
  CASE WHEN source_idx % 4 = 2 THEN 'junk ' || event_id
       WHEN source_idx % 4 = 3 AND line_no <= 17 + source_idx % 7 THEN 'junk ' || event_id
       ELSE value END AS value
FROM (
  SELECT *, event_id % 60 AS source_idx, 'mixed-' || (event_id % 60) AS source, event_id @DIV 60 + 1 AS line_no
  FROM (@LINES) AS l
) AS s
WHERE NOT (source_idx % 4 = 0 AND format = 'auth') AND NOT (source_idx % 4 = 1 AND format = 'web')
"""


def _text(template: str, words: dict[str, str]) -> str:
    text = template.replace("@LINES", _LINES)
    for word, meaning in words.items():
        text = text.replace(word, meaning)
    return text


DUCK_RUN = _text(_RUN, _DUCK)
DUCK_FILES = _text(_FILES, _DUCK)
DUCK_MIXED = _text(_MIXED, _DUCK)


# Events whose lines are written and parsed in one task.
EVENTS_A_TASK = 100_000


def _lines(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD)  # the text of a line is one such expression
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # A line costs more to parse than its event to move, and the number of splits does not tell how many of them have
    # rows: a file of one row group is read by one task, however many splits it has. So events are always dealt evenly.
    tasks = max(spark.sparkContext.defaultParallelism, -(-events.count() // EVENTS_A_TASK))
    events = events.select("event_id", "ts", "user_id", "event_type").repartition(tasks, "event_id")
    return spark.sql(_text(template, _SPARK).replace("FROM events", "FROM {events}"), events=events)


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a run over three sources, with their formats."""
    lines = _lines(spark, sf_dir, _RUN)
    return lines.selectExpr("source", "source_idx", "cast(line_no AS BIGINT) AS line_no", "value", "format")


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sources whose format is to be detected."""
    return _lines(spark, sf_dir, _MIXED).selectExpr(
        "source", "cast(source_idx AS INT) AS source_idx", "cast(line_no AS BIGINT) AS line_no", "value"
    )


def write_files(spark: SparkSession, sf_dir: str) -> str:
    """Text files ``<folder>/source=<name>/part-*`` of the rotated sources."""
    folder = scratch_path(spark, "logs")
    lines = _lines(spark, sf_dir, _FILES)
    spread = lines.repartition("source").sortWithinPartitions("source", "line_no")
    spread.select("value", "source").write.partitionBy("source").text(folder)
    return folder
