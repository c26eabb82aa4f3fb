"""One surviving record of each group of duplicates, chosen in bundles of dependent fields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.jsonx import members
from skyledger.functions.text import strip, usable


@dataclass(frozen=True)
class Bundle:
    """Fields that are taken from one row together. ``decides``: bundles whose values follow from this one's."""

    name: str
    fields: tuple[str, ...]
    decides: tuple[str, ...] = field(default=())


def _filled(b: Bundle) -> Column:
    """How many of the bundle's fields a row has."""
    return sum((F.col(f).isNotNull().cast("int") for f in b.fields), F.lit(0))


def choose_bundles(rows: DataFrame, group: str, row_id: str, bundles: list[Bundle], trust: str, recency: str, least_rows: int = 2) -> DataFrame:
    """One row per group of at least ``least_rows`` rows: group, group_id (its smallest row id), and for each bundle the id
    of the row that supplies it, null where no row holds any of the bundle's fields.

    Rows that hold more of a bundle come before rows that hold less, so partial rows supply it only where no row is
    complete. Among these maximises the trust of the chosen rows, then their recency, then the smallest id, bundle by
    bundle. ``rows`` have null in place of unusable values. Branch and bound: the bound of every branch is each bundle's
    greatest trust taken by itself, which one aggregation finds for all groups; where no functional dependency binds
    bundles, or the best rows meet it, the bound is reached and the group is closed. A deciding bundle branches on its
    distinct values, with all bundles that follow from it together; a branch whose own bound is below the incumbent's
    trust is cut, and of the rest the best is kept, all by partial aggregations, so no group is gathered.
    """
    by_name = {b.name: b for b in bundles}
    decided = [d for b in bundles for d in b.decides]
    if len(set(decided)) < len(decided):
        raise ValueError("a bundle may follow from one other only")
    t = F.coalesce(F.col(trust).cast("long"), F.lit(-1))
    rank = {b.name: F.when(_filled(b) > 0, F.struct(_filled(b).alias("f"), t.alias("t"), F.col(recency).alias("r"), (-F.col(row_id)).alias("i"))) for b in bundles}
    tops = [F.max(rank[b.name]).alias(f"_{b.name}") for b in bundles] + [F.max(F.when(_filled(by_name[d]) > 0, t)).alias(f"_most_{d}") for d in decided]
    root = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(row_id).alias("group_id"), F.count("*").alias("_n"), *tops).where(F.col("_n") >= least_rows)
    todo, bound = [b for b in bundles if b.decides], set()
    while todo:  # a bundle that follows from another one branches after it
        b = next((b for b in todo if not any(b.name in x.decides for x in todo)), None)
        if b is None:
            raise ValueError("bundles follow from each other in a circle")
        root = _bind(rows, root, group, row_id, b, [by_name[d] for d in b.decides], rank, b.name in bound)
        bound |= set(b.decides)
        todo.remove(b)
    return root.select(group, "group_id", *[(-F.col(f"_{b.name}.i")).alias(b.name) for b in bundles])


def _bind(rows: DataFrame, root: DataFrame, group: str, row_id: str, a: Bundle, following: list[Bundle], rank: dict[str, Column], settled: bool) -> DataFrame:
    """Makes bundles follow from bundle a: rows that hold a's chosen values say what they are. A settled a keeps its
    values; a partial a decides nothing, so that no value that only other rows have is lost."""
    key = F.struct(*[F.col(f) for f in a.fields]).alias("_key")
    names = [b.name for b in following]
    # Where one row is the best of all these bundles, or a isn't complete, the bound is reached: such groups don't branch.
    top = F.col(f"_{a.name}")
    one_row = F.lit(True)
    for n in names:
        one_row = one_row & (F.col(f"_{n}").isNull() | (F.col(f"_{n}.i") == top["i"]))
    closed = top.isNull() | (top["f"] < len(a.fields)) | F.coalesce(one_row, F.lit(False))
    everyone, root = root, root.where(~closed)
    rows = rows.join(root.select(group), group, "left_semi")
    branches = rows.where((_filled(a) == len(a.fields)) & F.col(group).isNotNull()).groupBy(F.col(group), key).agg(F.max(rank[a.name]).alias("_a"), *[F.max(rank[n]).alias(f"_b_{n}") for n in names])
    at = root.select(group, F.col(f"_{a.name}").alias("_top"), *[F.col(f"_most_{n}") for n in names])
    none = F.lit(-1).cast("long")
    score = sum((F.coalesce(F.col(f"_b_{n}.t"), none) for n in names), F.col("_a.t"))
    bound = sum((F.coalesce(F.col(f"_most_{n}"), none) for n in names), F.col("_a.t"))
    joined = branches.join(at, group).where(F.col("_top.f") == len(a.fields)).withColumn("_score", score).withColumn("_bound", bound)
    if settled:
        chosen = rows.join(root.select(group, (-F.col(f"_{a.name}.i")).alias(row_id)), [group, row_id]).select(group, key.alias("_chosen"))
        kept = joined.join(chosen, group).where(F.col("_key").eqNullSafe(F.col("_chosen"))).withColumn("_a", F.col("_top"))
    else:
        incumbent = joined.where(F.col("_a") == F.col("_top")).select(group, F.col("_score").alias("_inc"))
        kept = joined.join(incumbent, group).where(F.col("_bound") >= F.col("_inc"))
    columns = ["_a", *[f"_b_{n}" for n in names]]
    best = kept.groupBy(group).agg(F.max_by(F.struct(*columns), F.struct("_score", *columns)).alias("_won"))
    out = root.join(best, group, "left").withColumn(f"_{a.name}", F.coalesce(F.col("_won._a"), F.col(f"_{a.name}")))
    for n in names:
        out = out.withColumn(f"_{n}", F.when(F.col("_won").isNotNull(), F.col(f"_won._b_{n}")).otherwise(F.col(f"_{n}")))
    return everyone.where(closed).unionByName(out.drop("_won").select(*everyone.columns))


#: Members that a surviving operator is made of.
OPERATOR_FIELDS = ("name", "icao_code", "iata_code", "callsign", "head_office", "fleet_size")


def certificate(aoc: Column) -> Column:
    """Letters and digits of a certificate in upper case; null without a digit."""
    key = F.upper(F.regexp_replace(aoc, r"[^\p{L}\p{N}]", ""))
    return F.when(key.rlike(r"\p{N}"), key)


def operator_rows(sources: DataFrame, source_types: DataFrame) -> DataFrame:
    """Rows with certificate, trust and the usable values of ``data``; a type without known trust is trusted least."""
    m = sources.select("id", "type", "import_date", members(F.col("data")).alias("m"))
    value = {f: usable(F.col("m")[f]) for f in OPERATOR_FIELDS}
    fleet = value["fleet_size"]
    value["fleet_size"] = F.when(~F.coalesce(fleet.try_cast("double") == 0, F.lit(False)), fleet)
    value["icao_code"] = F.when(value["icao_code"].rlike(r"^[A-Za-z]{3}$"), value["icao_code"])
    # Two-character codes such as NA are no fillers.
    iata = strip(F.col("m")["iata_code"])
    value["iata_code"] = F.when(iata.rlike(r"^[A-Za-z0-9]{2}$"), iata)
    rows = m.select("id", "type", "import_date", certificate(F.col("m")["aoc"]).alias("certificate"), *[v.alias(f) for f, v in value.items()])
    trust = source_types.groupBy("type").agg(F.max("trust").alias("trust"))
    return rows.join(trust, "type", "left")


def operator_survivors(sources: DataFrame, source_types: DataFrame, bundles: list[Bundle] | None = None) -> DataFrame:
    """Per certificate the supplying row of each bundle, by default of each field alone."""
    bundles = bundles or [Bundle(f, (f,)) for f in OPERATOR_FIELDS]
    return choose_bundles(operator_rows(sources, source_types), "certificate", "id", bundles, "trust", "import_date")
