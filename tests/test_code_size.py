"""Generated code stays within what the JVM compiles; a larger method runs interpreted, several times slower."""

import re

import pytest
from pyspark.sql import functions as F

from checks.fixture import run_lines
from checks.queries import ANCHOR, RUN_SPECS
from logwarden.operators.entries import parse_lines
from logwarden.operators.signature import signature_hits
from logwarden.plans.rules import build_rules
from logwarden.session import HUGE_METHOD, materialise

SMALL = "/root/testdata/sf0.001"


def largest_method(df):
    plan = df._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))))


@pytest.fixture
def fixed_plan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_parsing_and_search_are_compiled(spark, fixed_plan):
    lines = materialise(run_lines(spark, SMALL), "lines")
    parsed = parse_lines(lines, reference_time=ANCHOR)
    assert largest_method(parsed) < int(HUGE_METHOD)
    written = materialise(parsed, "parsed")
    assert largest_method(signature_hits(written, build_rules(RUN_SPECS, spark))) < int(HUGE_METHOD)


def test_what_is_larger_is_left_to_its_operators(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    lines = run_lines(spark, SMALL)
    assert lines.agg(F.count("value")).first()[0] == spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == HUGE_METHOD
