"""Runs operators over relations: Engine(spark, relations).run("spatial_relations") returns a DataFrame; nothing runs until it is read."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from screenrel.dialect import Duck, Spark
from screenrel.operators import claims, pixels, queries  # noqa: F401  (they register themselves)
from screenrel.operators.catalog import OPERATORS
from screenrel.operators.folds import FOLDS
from screenrel.operators.oracles import ORACLES
from screenrel.plans.relations import RELATIONS, USES

TABLES = ("orders", "conversations", "events", "lineitem")


def needed(name: str) -> list[str]:
    """Relations of an operator and those that they are made from, in order."""
    return with_needs(OPERATORS[name].reads)


def with_needs(names: tuple[str, ...], given: frozenset[str] = frozenset()) -> list[str]:
    """The relations and what they are made from, in order; a given one is made from nothing."""
    wanted = set(names)
    for _ in RELATIONS:
        wanted |= {u for r in wanted - given for u in USES.get(r, ())}
    return [r for r in RELATIONS if r in wanted]


def oracle(name: str) -> str:
    """The operator over the driver's tables as one statement for the other engine."""
    d = Duck()
    reads, sql = (OPERATORS[name].reads, OPERATORS[name].sql(d)) if name in OPERATORS else (ORACLES[name][0], ORACLES[name][1]())
    parts = [f"{r} AS ({RELATIONS[r](d)})" for r in with_needs(reads)]
    return (f"WITH {', '.join(parts)} " if parts else "") + f"SELECT * FROM ({sql}) result"


class _Tables(Spark):
    def __init__(self, views: dict[str, str], made: frozenset[str], parts: int):
        super().__init__(made, parts)
        self.views = views

    def table(self, name: str) -> str:
        return self.views[name]


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived relation."""
    return _select(spark, sf_dir, with_needs((name,)), f"SELECT * FROM {name}")


def over_tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The operator over relations derived from the driver's tables."""
    if name in FOLDS:
        return FOLDS[name][1](relation(spark, sf_dir, FOLDS[name][0]))
    relations = needed(name)
    return _select(spark, sf_dir, relations, OPERATORS[name].sql(Spark(frozenset(relations))))


def partitions(spark: SparkSession) -> int:
    """For rows about to be exploded: more than a DISTINCT has, as Spark would leave out a second exchange by the same key and merge the partitions of the first."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _select(spark: SparkSession, sf_dir: str, relations: list[str], sql: str) -> DataFrame:
    text = " ".join(RELATIONS[r](Spark()) for r in relations)
    views = {}
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            views[t] = f"{t}_{uuid.uuid4().hex}"
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(views[t])
    d = _Tables(views, frozenset(relations), partitions(spark))
    parts = [f"{r} AS ({RELATIONS[r](d)})" for r in relations]
    return spark.sql((f"WITH {', '.join(parts)} " if parts else "") + sql)


class Engine:
    """Operators over a user's own relations, each a DataFrame keyed by page_id."""

    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame]):
        self.spark, self.views = spark, {}
        for name, df in relations.items():
            self.views[name] = f"{name}_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(self.views[name])

    def run(self, name: str, page_id: int | None = None) -> DataFrame:
        """An operator over all pages, or over one: the page filter reaches the scans."""
        if name in FOLDS:
            return FOLDS[name][1](self.rows(FOLDS[name][0], page_id))
        reads = OPERATORS[name].reads
        return self._select(reads, page_id, OPERATORS[name].sql(Spark(self.made(reads))))

    def made(self, names: tuple[str, ...]) -> frozenset[str]:
        """What is derived of the relations and those that they are made from."""
        return frozenset(with_needs(names, frozenset(self.views))) - frozenset(self.views)

    def rows(self, relation: str, page_id: int | None = None) -> DataFrame:
        """A relation given, or one derived from those given."""
        return self._select((relation,), page_id, f"SELECT * FROM {relation}")

    def _select(self, names: tuple[str, ...], page_id: int | None, sql: str) -> DataFrame:
        relations = with_needs(names, frozenset(self.views))
        d, where = Spark(self.made(names), partitions(self.spark)), "" if page_id is None else f" WHERE page_id = {int(page_id)}"
        parts = [f"{r} AS (SELECT * FROM {self.views[r]}{where})" if r in self.views else f"{r} AS ({RELATIONS[r](d)})" for r in relations]
        return self.spark.sql((f"WITH {', '.join(parts)} " if parts else "") + sql)
