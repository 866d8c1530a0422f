"""Outlet rules: loading, and matching hosts to the most specific rule."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import urls

SCHEMA = "id STRING, hosts ARRAY<STRING>, body_selectors ARRAY<STRING>, strip_selectors ARRAY<STRING>, strip_text_patterns ARRAY<STRING>, paywall_markers ARRAY<STRING>"


def _valid(patterns: list) -> list[str]:
    out = []
    for p in patterns or []:
        try:
            re.compile(p)
            out.append(p)
        except (re.error, TypeError):
            continue
    return out


def load(text: str) -> list[dict]:
    """Rules of a JSON file: those without a host are dropped, patterns that don't compile are skipped, and a file that can't
    be read is an empty catalogue."""
    try:
        found = json.loads(text)
    except ValueError:
        return []
    rows = found.get("rules", []) if isinstance(found, dict) else found if isinstance(found, list) else []
    out = []
    for k, r in enumerate(rows):
        hosts = [h.strip().lower().rstrip(".") for h in r.get("hosts", []) if isinstance(h, str) and h.strip()] if isinstance(r, dict) else []
        if hosts:
            out.append({"id": str(r.get("id", k)), "hosts": hosts, "body_selectors": r.get("body_selectors") or [], "strip_selectors": r.get("strip_selectors") or [], "strip_text_patterns": _valid(r.get("strip_text_patterns")), "paywall_markers": _valid(r.get("paywall_markers"))})
    return out


def table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The rules as rows of SCHEMA."""
    return spark.createDataFrame(rules, SCHEMA)


def for_hosts(rows: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """rows with rule_id: the rule with the longest host that is rows' host or a parent of it. Every host has a few parents, so
    this is an equality join."""
    known = rules.select(F.explode("hosts").alias("_h"), F.col("id").alias("_rule")).groupBy("_h").agg(F.min("_rule").alias("_rule"))
    suffixes = rows.select(F.col(host).alias("_host")).where("_host is not null").distinct().select("_host", F.explode(urls.host_suffixes(F.col("_host"))).alias("_h"))
    best = suffixes.join(known, "_h").groupBy("_host").agg(F.max_by("_rule", F.length("_h")).alias("rule_id"))
    return rows.join(best, F.col(host) == F.col("_host"), "left").drop("_host")
