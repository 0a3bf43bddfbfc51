"""Vocabularies: closed tables, event-sourced additions, unified views and audits."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.functions import text as X
from bomrec.functions.spans import MAX_ALIASES, Alias

SEED_DATE = "2026-08-22"
ENTRY_SCHEMA = (
    "attribute string, id string, alias string, kind string, value string, source string, "
    "decided_at string, ord int"
)


def fold_text(value: str) -> str:
    """Driver-side twin of ``functions.text.fold`` for closed-table literals."""
    bare = "".join(c for c in unicodedata.normalize("NFD", value) if not 0x300 <= ord(c) <= 0x36F)
    return " ".join(bare.upper().split())


@dataclass(frozen=True)
class FinishEntry:
    id: str
    alias: str
    finish: str | None
    kind: str = "alias"
    source: str = "added"
    decided_at: str = SEED_DATE


@dataclass(frozen=True)
class Vocabulary:
    """The live closed tables a run is evaluated against. Small by contract and checked on load."""

    names: tuple[Alias, ...] = ()
    materials: tuple[Alias, ...] = ()
    finishes: tuple[FinishEntry, ...] = ()
    quality_groups: dict = field(default_factory=lambda: dict(T.QUALITY_GROUPS))
    quality_aliases: tuple[Alias, ...] = ()  # text -> catalogue value
    quality_entries: tuple[Alias, ...] = ()  # text -> group, second layer
    standard_aliases: tuple[Alias, ...] = ()
    derivations: tuple = tuple((*d, SEED_DATE) for d in T.MATERIAL_DERIVATIONS)
    uncovered: tuple = T.MATERIAL_UNCOVERED

    @staticmethod
    def closed() -> Vocabulary:
        def aliases(table: dict) -> tuple[Alias, ...]:
            return tuple(
                Alias(text, value, source)
                for value, (client, added) in table.items()
                for source, texts in (("client", client), ("added", added))
                for text in texts
            )

        finishes = tuple(
            FinishEntry(
                f"seed-{stem}-" + "-".join(alias.lower().split()), alias, finish, "alias", source
            )
            for finish, (stem, client, added) in T.FINISH_ALIASES.items()
            for source, texts in (("client", client), ("added", added))
            for alias in texts
        )
        return Vocabulary(aliases(T.NAME_ALIASES), aliases(T.MATERIAL_ALIASES), finishes)

    def with_entries(self, entries: DataFrame) -> Vocabulary:
        """Add live entries (attribute, id, alias, kind, value, source, decided_at) to the tables."""
        rows = entries.limit(MAX_ALIASES + 1).collect()
        if len(rows) > MAX_ALIASES:
            raise ValueError("vocabulary is not a small closed table; use the join operators instead")
        rows.sort(key=lambda r: (r["decided_at"], r["id"]))

        def of(attribute: str, values=None) -> tuple[Alias, ...]:
            return tuple(
                Alias(r["alias"], r["value"], "added", r["id"])
                for r in rows
                if r["attribute"] == attribute and (values is None or r["value"] in values)
            )

        finishes = tuple(
            FinishEntry(r["id"], r["alias"], r["value"], r["kind"], r["source"], r["decided_at"])
            for r in rows
            if r["attribute"] == "finish"
        )
        values = [v for members in self.quality_groups.values() for v in members]
        return replace(
            self,
            names=self.names + of("name", T.NAME_ALIASES),
            finishes=self.finishes + finishes,
            quality_aliases=self.quality_aliases + of("quality", values),
            quality_entries=self.quality_entries + of("quality_group"),
            standard_aliases=self.standard_aliases + of("standard"),
            derivations=self.derivations
            + tuple((r["id"], r["kind"], r["alias"], r["value"], r["decided_at"]) for r in rows if r["attribute"] == "material"),
            uncovered=self.uncovered
            + tuple((r["kind"], r["alias"]) for r in rows if r["attribute"] == "uncovered"),
        )

    # -- views of the tables as folded lookups ------------------------------------------------

    @staticmethod
    def exact(aliases: tuple[Alias, ...]) -> dict[str, Alias]:
        """Folded text -> winning alias: the last client one, else the first added one."""
        best: dict[str, Alias] = {}
        for a in aliases:
            if a.source == "client" or fold_text(a.text) not in best:
                best[fold_text(a.text)] = a
        return best

    @staticmethod
    def scanned(aliases: tuple[Alias, ...]) -> dict[str, Alias]:
        """Folded text -> alias that claims the text in a scan: the first in table order."""
        first: dict[str, Alias] = {}
        for a in aliases:
            first.setdefault(fold_text(a.text), a)
        return first

    def group_by_value(self) -> dict[str, str]:
        return {fold_text(v): g for g, members in self.quality_groups.items() for v in members}

    def finish_table(self) -> dict[str, list[FinishEntry]]:
        table: dict[str, list[FinishEntry]] = {}
        for e in sorted(self.finishes, key=lambda e: (e.decided_at, e.id)):
            table.setdefault(fold_text(e.alias), []).append(e)
        return table


def vocabulary_frame(spark: SparkSession, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Every vocabulary layer in one table (attribute, id, alias, kind, value, source, ...)."""
    v = vocabulary or Vocabulary.closed()
    rows = [("name", a.entry_id, a.text, "alias", a.value, a.source, SEED_DATE) for a in v.names]
    rows += [("material", a.entry_id, a.text, "word", a.value, a.source, SEED_DATE) for a in v.materials]
    rows += [("material", i, value, kind, m, "added", at) for i, kind, value, m, at in v.derivations]
    rows += [("finish", e.id, e.alias, e.kind, e.finish, e.source, e.decided_at) for e in v.finishes]
    rows += [
        ("quality", None, value, "group", group, "client", SEED_DATE)
        for group, members in v.quality_groups.items()
        for value in members
    ]
    rows += [("quality", a.entry_id, a.text, "alias", a.value, a.source, SEED_DATE) for a in v.quality_aliases]
    rows += [("quality", a.entry_id, a.text, "entry", a.value, a.source, SEED_DATE) for a in v.quality_entries]
    rows += [
        ("standard", None, din, "equivalence", iso, "client", SEED_DATE)
        for din, iso in T.STANDARD_EQUIVALENCES.items()
    ]
    rows += [("standard", a.entry_id, a.text, "alias", a.value, a.source, SEED_DATE) for a in v.standard_aliases]
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], ENTRY_SCHEMA)


def current_entries(log: DataFrame) -> DataFrame:
    """Fold an add/retire event log (seq, action, id, at, ...) into its latest state per id.

    Replays of the same (action, id, at) count once; an add keeps the entry's own fields and a
    retire only closes it. Partial aggregation keeps a hot id to one row per task.
    """
    once = log.groupBy("action", "id", "at").agg(
        F.min("seq").alias("seq"),
        *[F.min_by(c, "seq").alias(c) for c in log.columns if c not in ("action", "id", "at", "seq")],
    )
    fields = [c for c in once.columns if c not in ("action", "id", "at", "seq")]
    added = F.col("action") == "add"
    last_add = F.max_by(
        F.struct(F.col("at").alias("decided_at"), *fields), F.when(added, F.col("seq"))
    )
    state = once.groupBy("id").agg(
        last_add.alias("entry"),
        F.max_by(F.struct("action", "at"), "seq").alias("last"),
        F.count_if(added).alias("adds"),
    )
    retired = F.col("last.action") == "retire"
    return state.filter("adds > 0").select(
        "id",
        "entry.*",
        F.when(retired, F.col("last.at")).alias("retired_at"),
    )


def live(entries: DataFrame) -> DataFrame:
    """Entries that have not been retired."""
    return entries.filter(F.col("retired_at").isNull())


def retired(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("retired_at").isNotNull())


def in_decision_order(entries: DataFrame) -> DataFrame:
    """By decision date, then id."""
    return entries.orderBy("decided_at", "id")


def finish_catalog(entries: DataFrame) -> DataFrame:
    """U4: the closed finishes plus every finish live aliases add, sorted after them."""
    spark = entries.sparkSession
    seed = spark.createDataFrame([(f, n) for n, f in enumerate(T.FINISH_CATALOG)], "finish string, pos int")
    extra = (
        live(entries)
        .filter((F.col("kind") == "alias") & F.col("value").isNotNull() & ~F.col("value").isin(*T.FINISH_CATALOG))
        .select(F.col("value").alias("finish"))
        .distinct()
        .select("finish", F.lit(len(T.FINISH_CATALOG)).alias("pos"))
    )
    return seed.unionByName(extra).orderBy("pos", "finish")


def alias_audit(entries: DataFrame) -> DataFrame:
    """Client against added aliases per attribute."""
    return entries.groupBy("attribute").agg(
        F.count_if(F.col("source") == "client").alias("client"),
        F.count_if(F.col("source") == "added").alias("added"),
    )


def is_own_group(group: Column | str) -> Column:
    return F.startswith(X.col(group), F.lit("V-"))


def is_known_group(group: Column | str) -> Column:
    """one of the closed groups, or a well-formed own group."""
    g = X.col(group)
    return g.isin(*T.QUALITY_GROUPS) | (is_own_group(g) & (F.length(g) > 2))


def quality_groups(entries: DataFrame) -> DataFrame:
    """Members of the closed groups and of the own groups of live entries, one per record."""
    closed = entries.sparkSession.createDataFrame(
        [(g, False, v) for g, m in T.QUALITY_GROUPS.items() for v in m],
        "group_id string, own boolean, member string",
    )
    own = live(entries).filter(is_own_group("value")).select(
        F.col("value").alias("group_id"), F.lit(True).alias("own"), F.col("alias").alias("member")
    )
    return closed.unionByName(own)


def catalogue_coverage(values: DataFrame, observed: DataFrame) -> DataFrame:
    """Per catalogue kind, how many defined values the data exercises.

    ``values`` (kind, value) is the closed side; ``observed`` (kind, value) is reduced to its
    distinct values before the join, so the shuffle carries the catalogue, not the data.
    """
    seen = observed.select("kind", "value").distinct().withColumn("seen", F.lit(True))
    return values.join(seen, ["kind", "value"], "left").groupBy("kind").agg(
        F.count_if("seen").alias("exercised"), F.count(F.lit(1)).alias("defined")
    )


def allocate_ids(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """An id whose entry was retired gets the next free ``-2``, ``-3`` ... suffix.

    ``wanted`` (id) and ``taken`` (id, retired_at). Live clashes keep their id and fail later in the
    duplicate guard.
    """
    stem = F.regexp_extract("id", "^(.*?)-([0-9]+)$", 1)
    number = F.regexp_extract("id", "^(.*?)-([0-9]+)$", 2).try_cast("int")
    suffixed = (
        taken.select(stem.alias("stem"), number.alias("n"))
        .filter("n >= 2 and stem <> ''")
        .distinct()
    )
    w = Window.partitionBy("stem").orderBy("n")
    first_gap = (
        suffixed.withColumn("expected", F.row_number().over(w) + 1)
        .groupBy("stem")
        .agg(F.count_if(F.col("n") == F.col("expected")).alias("run"))
        .select(F.col("stem").alias("id"), (F.col("run") + 2).alias("next"))
    )
    state = taken.groupBy("id").agg(F.bool_and(F.col("retired_at").isNotNull()).alias("is_retired"))
    return (
        wanted.join(state, "id", "left")
        .join(first_gap, "id", "left")
        .select(
            F.col("id").alias("wanted_id"),
            F.when(
                F.coalesce("is_retired", F.lit(False)),
                F.concat("id", F.lit("-"), F.coalesce("next", F.lit(2)).cast("string")),
            )
            .otherwise(F.col("id"))
            .alias("allocated_id"),
        )
    )
