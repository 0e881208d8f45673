"""Between a roster and its copies: residents to push or to pull, edits to pull back, and who may be a duplicate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources import working
from . import audit, fill, guard, keyed


def push_missing(master: DataFrame, sheets: DataFrame, n: audit.Names = audit.Names(), sensitive: Iterable[str] = (), order: str = "src_row") -> DataFrame:
    """sheet, resident_id, zone, action, reason, flags: the master's rows of each sheet's zone that the sheet lacks.

    ``flags`` names the sensitive columns that a row would bring along.
    """
    flags = F.array_join(F.array_compact(F.array(*[F.when(~V.source_blank(F.col(c), V.kind_of(master.schema[c].dataType)), F.lit(c)) for c in sensitive])), ", ") if sensitive else F.lit("")
    rows = master.select(V.identity(F.col(n.id)).alias("resident_id"), V.text(F.col(n.zone)).alias("zone"), F.col(order).alias("master_row"), flags.alias("flags"))
    wanted = audit.zones(sheets, n).join(rows, "zone")
    blank = wanted.filter("resident_id = ''").select("sheet", "resident_id", "zone", "master_row", F.lit("skip").alias("action"), F.lit("no resident_id").alias("reason"), "flags")
    real = wanted.filter("resident_id <> ''")
    first = real.groupBy("sheet", "resident_id").agg(F.min(F.struct("master_row", "zone", "flags")).alias("r")).select("sheet", "resident_id", "r.*")
    here = sheets.select("sheet", V.identity(F.col(n.id)).alias("resident_id"), F.lit(True).alias("here")).filter("resident_id <> ''").distinct()
    marked = first.join(here, ["sheet", "resident_id"], "left")
    is_here = F.col("here").isNotNull()
    planned = marked.select("sheet", "resident_id", "zone", "master_row", F.when(is_here, "skip").otherwise("append").alias("action"), F.when(is_here, "on the sheet already").otherwise("").alias("reason"), F.when(is_here, "").otherwise(F.col("flags")).alias("flags"))
    return planned.unionByName(blank)


def pull_changes(master: DataFrame, sheets: DataFrame, columns: Mapping[str, str], policies: Mapping[str, str] | None = None, default: str = "conflict", key: str = "resident_id", order: str = "src_row", protected: Iterable[str] = guard.PROTECTED, all_cells: bool = False) -> DataFrame:
    """Changes for the master from the sheets' cells: ids that the master has once; of a sheet's equal ids the first row."""
    target = keyed.multiplicity(master, key, order)
    mine = target.filter("_n = 1").select(V.identity(F.col(key)).alias("identity"), F.struct(*master.columns).alias("t"))
    theirs = keyed.multiplicity(sheets, key, "sheet_row", ["sheet"]).select("sheet", "sheet_row", V.identity(F.col(key)).alias("identity"), F.struct(*sheets.columns).alias("s"))
    joined = theirs.join(mine, "identity")
    out = fill.compare(joined, columns, policies or {}, default, protected)
    return out if all_cells else out.filter(F.col("action").isin("fill", "overwrite", "conflict") | ((F.col("action") == "skip") & (F.col("policy") == "never")))


def pull_skips(master: DataFrame, sheets: DataFrame, key: str = "resident_id", order: str = "src_row") -> DataFrame:
    """sheet, sheet_row, identity, reason: ambiguous, repeated and unknown ids of the sheets."""
    many = keyed.multiplicity(master, key, order).select(V.identity(F.col(key)).alias("identity"), F.col("_n").alias("in_master"))
    rows = sheets.select("sheet", "sheet_row", V.identity(F.col(key)).alias("identity"))
    first = rows.filter("identity <> ''").groupBy("sheet", "identity").agg(F.min("sheet_row").alias("first"))
    seen = rows.join(first, ["sheet", "identity"], "left").join(many, "identity", "left")
    reason = (
        F.when(F.col("identity") == "", "no resident_id")
        .when(F.col("sheet_row") > F.col("first"), "later row of its id")
        .when(F.col("in_master").isNull(), "not on the master")
        .when(F.col("in_master") > 1, "on several rows of the master")
    )
    return seen.select("sheet", "sheet_row", "identity", reason.alias("reason")).filter("reason is not null")


def first_wins(sheets: DataFrame, key: str = "resident_id", ordinal: str = "sheet") -> DataFrame:
    """One row for each id over all sheets: that of the first sheet, then the first row."""
    return keyed.one_per_key(sheets, key, [ordinal, "sheet_row"] if ordinal != "sheet" else ["sheet", "sheet_row"])


def pull_folder(master: DataFrame, sheets: DataFrame, columns: Mapping[str, str], policies: Mapping[str, str] | None = None, default: str = "conflict", key: str = "resident_id", order: str = "src_row") -> tuple[DataFrame, DataFrame]:
    """(changes of known residents, new rows) of a whole folder: each id is taken from the first sheet and row that has it."""
    rows = first_wins(sheets, key)
    known = master.select(V.identity(F.col(key)).alias("_id")).filter("_id <> ''").distinct()
    new = rows.withColumn("_id", V.identity(F.col(key))).join(known, "_id", "left_anti").drop("_id")
    return pull_changes(master, rows, columns, policies, default, key, order), numbered(new, master, order)


def numbered(new: DataFrame, target: DataFrame, order: str, by: tuple[str, ...] = ("sheet", "sheet_row")) -> DataFrame:
    """New rows with the row numbers (``order``) that follow the target's last.

    Range parts are sorted and written once, and places are counted up over the parts (:func:`working.placed`).
    """
    last = target.agg(F.coalesce(F.max(order), F.lit(1)).cast("long")).first()[0]
    placed = working.placed(new.repartitionByRange(*by).sortWithinPartitions(*by), "_place")
    return placed.withColumn(order, F.lit(last) + F.col("_place") + 1).drop("_place")


def verdicts(master: DataFrame, sheets: DataFrame, key: str = "resident_id", name: str = "resident_name") -> DataFrame:
    """sheet, sheet_row, identity, verdict, matched_id for ids that the master lacks: the id in another spelling, the name, or neither."""
    m = master.select(V.identity(F.col(key)).alias("id"), F.nullif(V.normal_key(F.col(key)), F.lit("")).alias("loose"), F.nullif(V.normal_key(F.col(name)), F.lit("")).alias("name")).filter("id <> ''")
    rows = sheets.select("sheet", "sheet_row", V.identity(F.col(key)).alias("identity"), F.nullif(V.normal_key(F.col(key)), F.lit("")).alias("loose"), F.nullif(V.normal_key(F.col(name)), F.lit("")).alias("name")).filter("identity <> ''")
    rows = rows.join(m.select(F.col("id").alias("identity")).distinct(), "identity", "left_anti")
    for column in ("loose", "name"):
        rows = rows.join(m.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("id").alias(f"by_{column}")), column, "left")
    verdict = F.when(F.col("by_loose").isNotNull(), "id in another spelling").when(F.col("by_name").isNotNull(), "name under another id").otherwise("not on the master")
    return rows.select("sheet", "sheet_row", "identity", verdict.alias("verdict"), F.coalesce("by_loose", "by_name", F.lit("")).alias("matched_id"))


def fingerprint(changes: DataFrame, *by: str) -> DataFrame:
    """by, n, fingerprint: of a plan's writes, one line (identity, column, value) each. A row for each ``by``, or one.

    Lines are dealt by the first three digits of their SHA-256; the fingerprint is that of the parts' own, in order, so that
    no task gathers a whole plan and the result doesn't depend on how rows were dealt.
    """
    line = F.concat_ws("\t", "identity", "column", V.text(F.col("incoming")))
    lines = changes.filter("will_write").select(*by, line.alias("line")).withColumn("part", F.substring(F.sha2("line", 256), 1, 3))
    parts = lines.groupBy(*by, "part").agg(F.count("*").alias("n"), V.fingerprint(F.collect_list("line")).alias("digest"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"])  # 4,096 at most
    return parts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(whole, "\n"), 256).alias("fingerprint"))


def multiset_fingerprint(changes: DataFrame, *by: str) -> DataFrame:
    """by, n, fingerprint: of a plan's writes as :func:`fingerprint` takes them, by sums that need no order and no list.

    The eight 32-bit words of each line's SHA-256 are added up modulo 2 ** 32, so tasks hold eight numbers a group and pass these
    on; a line that is changed, added or doubled changes a sum. The fingerprint is the SHA-256 of the count and the sums.
    """
    line = F.concat_ws("\t", "identity", "column", V.text(F.col("incoming")))
    hashed = changes.filter("will_write").select(*by, F.sha2(line, 256).alias("h"))
    words = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(10,0)") for k in range(8)]
    sums = hashed.groupBy(*by).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(w), F.lit(0)).alias(f"_{k}") for k, w in enumerate(words)])
    parts = [(F.col(f"_{k}") % 4294967296).cast("long").cast("string") for k in range(8)]
    return sums.select(*by, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *parts), 256).alias("fingerprint"))


def push_rows(master: DataFrame, planned: DataFrame, columns: Iterable[str], key: str = "resident_id", order: str = "src_row") -> DataFrame:
    """sheet and ``columns`` (a copy's headers) of the rows that :func:`push_missing` appends; the master's columns by header."""
    new = planned.filter("action = 'append'").select("sheet", "master_row")
    cells = [F.col(c) if c in master.columns else F.lit("").alias(c) for c in columns]
    return new.join(master.withColumn("master_row", F.col(order)), "master_row").select("sheet", *cells)


def append_missing(master: DataFrame, sheets: DataFrame, key: str = "resident_id", order: str = "src_row") -> DataFrame:
    """The master with columns that only the sheets have (empty) and with the rows that it lacks, the first of each id."""
    own = [c for c in sheets.columns if c not in ("sheet", "sheet_row")]
    wide = fill.with_columns(master, own)
    known = master.select(V.identity(F.col(key)).alias("_id")).filter("_id <> ''").distinct()
    new = first_wins(sheets, key).withColumn("_id", V.identity(F.col(key))).join(known, "_id", "left_anti").drop("_id")
    placed = numbered(new, master, order)
    cells = [F.col(c).cast(wide.schema[c].dataType) if c in placed.columns else F.lit("" if wide.schema[c].dataType.simpleString() == "string" else None).cast(wide.schema[c].dataType).alias(c) for c in wide.columns]
    return wide.unionByName(placed.select(*cells))


def new_residents(master: DataFrame, sheet: DataFrame, key: str = "resident_id", name: str = "resident_name", apn: str = "apn", email: str = "email", required: Iterable[str] = ("resident_name",), order: str = "src_row", per_sheet: bool = True, house: Iterable[str] = ("house",), street: Iterable[str] = ("street",)) -> DataFrame:
    """sheet, sheet_row, resident_id, risk, reason, matched_id, missing, property, filled_columns: residents that the master lacks, screened.

    The first of these decides: name and parcel on the master, email on the master, name and parcel on an earlier row of
    the batch, email on an earlier row, name on the master (possible). All else is none. Wide rows are shuffled twice, by sheet and
    id and by id, once few are left; the keys of all rules are looked up in one join of narrow rows, and the least rule with a hit counts.
    """

    def keyed_columns(df: DataFrame) -> DataFrame:
        a, b, c = V.normal_key(F.col(name)), V.normal_key(F.col(apn)), V.normal_key(F.col(email))
        return df.withColumns({"_id": V.identity(F.col(key)), "_name": F.nullif(a, F.lit("")), "_email": F.nullif(c, F.lit("")), "_np": F.when((a != "") & (b != ""), F.concat_ws("|", a, b))})

    known = keyed_columns(master).filter("_id <> ''")
    # Of equal ids of a sheet the first row, picked in each task before it is shuffled; then those that the master lacks.
    rows = keyed_columns(sheet).filter("_id <> ''").select(F.struct("sheet_row", *[F.col(f"`{c}`") for c in sheet.columns if c != "sheet_row"], "_name", "_email", "_np").alias("r"), "_id", "sheet")
    strangers = rows.groupBy("_id", *(["sheet"] if per_sheet else [])).agg(F.min("r").alias("r")).join(known.select("_id"), "_id", "left_anti").select("_id", "r.*")
    lacking = F.array_join(F.array_compact(F.array(*[F.when(V.text(F.col(c)) == "", F.lit(c)) for c in required])), ", ")
    # The first of several columns that is filled; columns that the sheet lacks don't count.
    at = V.trim(F.concat_ws(" ", *(V.first_filled(*[F.col(c) for c in names if c in sheet.columns]) for names in (house, street))))
    parcel = V.text(F.col(apn))
    place = F.concat_ws(" · ", F.nullif(at, F.lit("")), F.when(parcel != "", F.concat(F.lit("APN "), parcel)))
    filled = sum((F.when(V.text(F.col(c)) != "", 1).otherwise(0) for c in master.columns if c in sheet.columns), F.lit(0))
    own = strangers.select("_id", "sheet", "sheet_row", "_np", "_email", "_name", F.struct(lacking.alias("missing"), place.alias("property"), filled.alias("filled_columns")).alias("payload"))
    # Rules in their order: where a key is looked up (the master, or the batch), by which column, and what a hit says.
    rules = [
        ("master", "_np", "likely", "name and parcel on the master"),
        ("master", "_email", "likely", "email on the master"),
        ("batch", "_np", "likely", "name and parcel earlier in the batch"),
        ("batch", "_email", "likely", "email earlier in the batch"),
        ("master", "_name", "possible", "name on the master, at another parcel"),
    ]
    scope = F.col("sheet") if per_sheet else F.lit("")

    def entry(k: int) -> Column:
        where, column, *_ = rules[k]
        return F.struct(F.lit(k).alias("rule"), (scope if where == "batch" else F.lit("")).alias("scope"), F.col(column).alias("key"))

    def exploded(df: DataFrame, which: list[int], at: str) -> DataFrame:
        entries = F.filter(F.array(*[entry(k) for k in which]), lambda e: e["key"].isNotNull())
        return df.select(F.struct(F.col(at).cast("long").alias("at"), F.col("_id").alias("id")).alias("found"), F.inline(entries))

    by = {w: [k for k, r in enumerate(rules) if r[0] == w] for w in ("master", "batch")}
    firsts = exploded(known.withColumn("sheet", F.lit("")), by["master"], order).unionByName(exploded(own, by["batch"], "sheet_row")).groupBy("rule", "scope", "key").agg(F.min("found").alias("found"))
    # Every row asks by each of its keys, and once more with what it brings along, under its id.
    asked = F.concat(F.filter(F.array(*[entry(k) for k in range(len(rules))]), lambda e: e["key"].isNotNull()), F.array(F.struct(F.lit(len(rules)).alias("rule"), F.lit("").alias("scope"), F.col("_id").alias("key"))))
    asks = own.select("_id", "sheet", "sheet_row", "payload", F.inline(asked)).withColumn("payload", F.when(F.col("rule") == len(rules), F.col("payload")))
    told = asks.join(firsts, ["rule", "scope", "key"], "left")
    earlier = F.col("rule").isin(by["master"]) | (F.col("found.at") < F.col("sheet_row"))
    hit = F.when(F.col("found").isNotNull() & earlier, F.struct("rule", F.col("found.id").alias("id")))
    out = told.groupBy("sheet", "sheet_row", "_id").agg(F.min(hit).alias("hit"), F.first("payload", ignorenulls=True).alias("p"))

    def said(k: int, otherwise: str) -> Column:
        return F.coalesce(F.get(F.array(*[F.lit(r[k]) for r in rules]), F.col("hit.rule")), F.lit(otherwise))

    return out.select("sheet", "sheet_row", F.col("_id").alias("resident_id"), said(2, "none").alias("risk"), said(3, "").alias("reason"), F.coalesce("hit.id", F.lit("")).alias("matched_id"), "p.missing", "p.property", "p.filled_columns")
