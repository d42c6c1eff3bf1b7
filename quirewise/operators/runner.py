"""Registry of checks, own ones included, and runs of several of them with faults kept apart."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.operators import search as Q
from quirewise.runtime import materialise

Check = Callable[[SparkSession, str], DataFrame]
#: Checks by name: each gives paper_id, traffic_light and its own summary columns.
REGISTRY: dict[str, Check] = {}
# The lights a check may show.
LIGHTS = ("green", "yellow", "red", "info", "na", "fail")


def register(name: str) -> Callable[[Check], Check]:
    """Put a check into the registry; a second one of the same name takes its place."""

    def keep(f: Check) -> Check:
        REGISTRY[name] = f
        return f

    return keep


def select_checks(known: Iterable[str], asked: Iterable[str] | None = None, allowed: Iterable[str] | None = None, online: Iterable[str] = (), use_online: bool = True) -> list[str]:
    """The known checks that are asked for (all if none are named) and allowed, in their own order, without online ones if those aren't wanted."""
    want = None if asked is None else set(asked)
    may = None if allowed is None else set(allowed)
    return [k for k in known if (want is None or k in want) and (may is None or k in may) and (use_online or k not in set(online))]


def run_checks(spark: SparkSession, d: str, names: Iterable[str], more: dict[str, Check] | None = None, execute: bool = False) -> DataFrame:
    """(paper_id, check, traffic_light, message) of the named checks on every paper.

    An unknown check, or one whose plan can't be made, is ``fail`` for every paper with the reason as message and stops no other. With
    ``execute`` each check is run and written down by itself, so that a fault that only shows in running stops no other either.
    """
    known = {**(more or {}), **REGISTRY}
    papers, out = Q.papers(spark, d), None
    for n in names:
        try:
            rows = papers.join(known[n](spark, d).select("paper_id", "traffic_light"), "paper_id", "left").select("paper_id", F.lit(n).alias("check"), F.coalesce("traffic_light", F.lit("na")).alias("traffic_light"), F.lit(None).cast("string").alias("message"))
            rows = materialise(rows) if execute else rows
        except Exception as e:  # whatever a check does wrong is that check's result
            reason = f"unknown check {n}" if isinstance(e, KeyError) and n not in known else f"{type(e).__name__}: {str(e)[:200]}"
            rows = papers.select("paper_id", F.lit(n).alias("check"), F.lit("fail").alias("traffic_light"), F.lit(reason).alias("message"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else papers.limit(0).select("paper_id", *[F.lit(None).cast("string").alias(c) for c in ("check", "traffic_light", "message")])
