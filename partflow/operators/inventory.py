"""Stock changes as table operators: (state, requests) -> (new state, events, rejects). Nothing has side effects.

Requests carry ``seq``, their order of arrival; every "last wins" and "first wins" goes by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from partflow.functions.text import clean_raw_number, normalize_part_number
from partflow.operators.folds import HOT_ROWS, block_starts
from partflow.operators.numbering import numbered


def _last(value: str, present: Column | None = None) -> Column:
    """The value of the last row that has one."""
    return F.max_by(F.struct(F.col(value)), F.when(present if present is not None else F.col(value).isNotNull(), F.col("seq")))[value]


def add_parts(parts: DataFrame, adds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intake (seq, part_number, brand, description, quantity, note): quantities add up per normalised number.

    Brand and description change only where given, the raw number stays as first entered. New parts get
    ids after the largest, in the order of their first request. Returns (parts, events).
    """
    asked = adds.withColumn("number", normalize_part_number(F.col("part_number")))
    # Texts among the results make this a sorted aggregate: requests are dealt by number first, so that they are sorted in one task with nothing else.
    rolled = asked.repartition("number").groupBy("number").agg(
        F.sum("quantity").cast("int").alias("more"), _last("brand").alias("new_brand"), _last("description").alias("new_description"),
        F.min_by(clean_raw_number(F.col("part_number")), "seq").alias("raw"), F.min("seq").alias("first_seq"),
    )
    joined = parts.join(rolled, parts["part_number"] == rolled["number"], "full_outer")
    fresh = joined.where("id IS NULL").select("number", "first_seq")
    ids = numbered(fresh, "first_seq", "number").withColumn("new_id", F.col("position") + F.coalesce(parts.agg(F.max("id")).scalar(), F.lit(0))).select(F.col("number").alias("n"), "new_id")
    state = joined.join(ids, joined["number"] == ids["n"], "left").select(
        F.coalesce("id", "new_id").alias("id"), F.coalesce("part_number", "number").alias("part_number"), F.coalesce("part_number_raw", "raw").alias("part_number_raw"),
        F.coalesce("new_brand", "brand").alias("brand"), F.coalesce("new_description", "description").alias("description"),
        (F.coalesce("quantity", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("quantity"), F.coalesce("listed_quantity", F.lit(0)).alias("listed_quantity"), "ebay_listing_id",
    )
    known = state.select(F.col("id").alias("part_id"), F.col("part_number").alias("number"))
    events = asked.join(known, "number").select("seq", "part_id", F.lit("added").alias("event_type"), F.col("quantity").alias("quantity_change"), "note")
    return state, events


def deplete_parts(parts: DataFrame, requests: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Withdrawals (seq, part_id, quantity, reason, note), in order for each part.

    A request for more than is available is rejected and takes nothing, so a later smaller one may still
    pass. Returns (parts, events, rejects).
    """
    stock = parts.select(F.col("id").alias("_id"), F.col("quantity").cast("int").alias("_stock"), F.col("listed_quantity").cast("int").alias("_listed"))
    asked = requests.select("seq", "part_id", F.col("quantity").cast("int").alias("take"), "reason", "note").join(stock, F.col("part_id") == F.col("_id"), "left")
    # One part's requests stand together in order, so a task carries one running stock; of very many, each block from its own start.
    order = ("seq", "take", "reason", "note")
    started = block_starts(asked.withColumn("_room", F.col("_stock") - F.col("_listed")), "part_id", order, "take", "_room", hot_rows)
    dealt = started.select(*asked.columns, "_block", F.col("_used").cast("int").alias("_used")).repartition("part_id", "_block").sortWithinPartitions("part_id", "_block", *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, left = object(), None
        for batch in batches:
            ok, free, after = [], [], []
            for key, take, stock, listed, block, used in zip(*(batch.column(c).to_pylist() for c in ("part_id", "take", "_stock", "_listed", "_block", "_used"))):
                if (key, block) != part:
                    part, left = (key, block), None if stock is None else stock - used
                room = None if left is None or listed is None else left - listed
                good = room is not None and take is not None and take <= room
                left = left - take if good else left
                ok.append(good)
                free.append(room)
                after.append(left)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(free, pa.int32()), pa.array(after, pa.int32())], [*batch.schema.names, "ok", "free", "after"])

    fields = T.StructType([*dealt.schema.fields, T.StructField("ok", T.BooleanType()), T.StructField("free", T.IntegerType()), T.StructField("after", T.IntegerType())])
    rows = dealt.mapInArrow(fold, fields)
    events = rows.where("ok").select("seq", "part_id", F.col("reason").alias("event_type"), (-F.col("take")).alias("quantity_change"), "note")
    text = F.when(F.col("_id").isNull(), "Part not found").otherwise(F.concat(F.lit("Cannot deplete "), "take", F.lit(" — only "), "free", F.lit(" available ("), "_listed", F.lit(" listed on eBay)")))
    rejects = rows.where("NOT ok").select("seq", "part_id", F.col("take").alias("quantity"), text.alias("message"))
    left = rows.where("ok").groupBy(F.col("part_id").alias("_id")).agg(F.min("after").alias("_left"))
    state = parts.join(left, parts["id"] == left["_id"], "left").withColumn("quantity", F.coalesce("_left", "quantity")).drop("_id", "_left")
    return state, events, rejects


def check_listing(df: DataFrame) -> DataFrame:
    """Rows of quantity, listed_quantity and ebay_listing_id with the reason why they cannot stand, or null."""
    none = F.coalesce(F.col("ebay_listing_id"), F.lit("")) == ""
    reason = (
        F.when((F.col("listed_quantity") < 0) | (F.col("listed_quantity") > F.col("quantity")), F.concat(F.lit("listed_quantity must be between 0 and "), "quantity"))
        .when((F.col("listed_quantity") > 0) & none, "ebay_listing_id required when listed_quantity > 0")
        .when((F.col("listed_quantity") == 0) & ~none, "ebay_listing_id must be null when listed_quantity is 0")
    )
    return df.withColumn("message", reason)


PATCHED = ("brand", "description", "ebay_listing_id", "listed_quantity")
_FLAGS = tuple(f"has_{c}" for c in PATCHED)


def _patched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patches that come sorted by part and order, each with its part's columns before any: the columns after it, and why it was refused."""
    part, state, turn = object(), {}, 0
    for batch in batches:
        after, messages, turns = [], [], []
        for row in batch.to_pylist():
            if row["part_id"] != part:
                part, state, turn = row["part_id"], {c: row[f"_{c}"] for c in PATCHED}, 0
            turn += 1
            turns.append(turn)
            new = {c: row[c] if row[f"has_{c}"] else state[c] for c in PATCHED}
            if new["listed_quantity"] is None:
                new["listed_quantity"] = state["listed_quantity"]
            listed, none, stock = new["listed_quantity"], not new["ebay_listing_id"], row["_quantity"]
            message = None
            if listed is not None and (listed < 0 or stock is not None and listed > stock):
                message = None if stock is None else f"listed_quantity must be between 0 and {stock}"
            elif listed is not None and listed > 0 and none:
                message = "ebay_listing_id required when listed_quantity > 0"
            elif listed == 0 and not none:
                message = "ebay_listing_id must be null when listed_quantity is 0"
            state = state if message else new
            after.append(state)
            messages.append(message)
        columns = [pa.array([s[c] for s in after], pa.int32() if c == "listed_quantity" else pa.string()) for c in PATCHED]
        yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("part_id"), pa.array(messages, pa.string()), pa.array(turns, pa.int64()), *columns], ["seq", "part_id", "message", "turn", *PATCHED])


def update_parts(parts: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patches (seq, part_id, and for each of ``PATCHED`` a value and a flag ``has_<column>``), in order for each part.

    A set flag with a null value clears, an unset flag keeps; a patch that breaks the listing rules
    changes nothing. Returns (parts, rejects). A part's patches stand together in order, so a task carries one
    running state through them, whatever their number.
    """
    before = parts.select(F.col("id").alias("_id"), F.col("quantity").cast("int").alias("_quantity"), *(F.col(c).cast("int" if c == "listed_quantity" else "string").alias(f"_{c}") for c in PATCHED))
    typed = [F.col(c).cast("int" if c == "listed_quantity" else "string").alias(c) for c in PATCHED]
    asked = patches.select(F.col("seq").cast("long").alias("seq"), "part_id", *typed, *_FLAGS)
    joined = asked.join(before, asked["part_id"] == before["_id"]).drop("_id")
    dealt = joined.repartition("part_id").sortWithinPartitions("part_id", "seq", *PATCHED, *_FLAGS)
    kept = ", ".join(f"{c} {'int' if c == 'listed_quantity' else 'string'}" for c in PATCHED)
    rows = dealt.mapInArrow(_patched, f"seq long, part_id {dealt.schema['part_id'].dataType.simpleString()}, message string, turn long, {kept}")
    last = rows.where("message IS NULL").groupBy(F.col("part_id").alias("_id")).agg(F.max_by(F.struct(*PATCHED), "turn").alias("_new"))
    state = parts.join(last, parts["id"] == last["_id"], "left")
    changed = F.col("_id").isNotNull()
    columns = [F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)).cast(parts.schema[c].dataType).alias(c) if c in PATCHED else F.col(c) for c in parts.columns]
    unknown = asked.join(before.select(F.col("_id").alias("part_id")), "part_id", "left_anti").select("seq", "part_id", F.lit("Part not found").alias("message"))
    return state.select(*columns), rows.where("message IS NOT NULL").select("seq", "part_id", "message").unionByName(unknown)


def delete_parts(parts: DataFrame, events: DataFrame, xrefs: DataFrame, processed: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parts (``ids``: part_id) with their events and cross-references; parts with processed lines are blocked.

    Returns (parts, events, cross-references, blocked ids).
    """
    asked = ids.select("part_id").distinct()
    blocked = asked.join(processed.select("part_id"), "part_id", "left_semi")
    gone = asked.join(processed.select("part_id"), "part_id", "left_anti")
    return parts.join(gone, parts["id"] == gone["part_id"], "left_anti"), events.join(gone, "part_id", "left_anti"), xrefs.join(gone, "part_id", "left_anti"), blocked


def delete_appliances(appliances: DataFrame, parts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appliances leave (``ids``: id); their parts stay without one. Returns (appliances, parts)."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    left = appliances.join(gone, appliances["id"] == gone["_gone"], "left_anti")
    unlinked = parts.join(gone, parts["appliance_id"] == gone["_gone"], "left")
    return left, unlinked.withColumn("appliance_id", F.when(F.col("_gone").isNull(), F.col("appliance_id"))).drop("_gone")


def patch_appliances(appliances: DataFrame, patches: DataFrame, columns: tuple[str, ...] = ("brand", "model_number", "status")) -> DataFrame:
    """Appliances with the last given value of each column (patches: seq, id and the columns; null keeps)."""
    last = patches.groupBy("id").agg(*(_last(c).alias(f"_{c}") for c in columns))
    joined = appliances.join(last, "id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*appliances.columns)


def create_appliances(appliances: DataFrame, rows: DataFrame) -> DataFrame:
    """New appliances (seq and columns) with ids after the largest, status active."""
    last = F.coalesce(appliances.agg(F.max("id")).scalar(), F.lit(0))
    made = numbered(rows, "seq", "seq").withColumns({"id": F.col("position") + last, "status": F.lit("active")})
    return appliances.unionByName(made.select(*(c for c in appliances.columns if c in made.columns)), allowMissingColumns=True)


def pull_parts(appliances: DataFrame, parts: DataFrame, adds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intake from appliances (adds with appliance_id): a default note names the appliance, the part is linked to it."""
    names = appliances.select(F.col("id").alias("appliance_id"), F.concat_ws(" ", "brand", "model_number").alias("_title"))
    note = F.coalesce("note", F.concat(F.lit("Pulled from "), "_title", F.lit(" (appliance #"), "appliance_id", F.lit(")")))
    noted = adds.join(names, "appliance_id").withColumn("note", note)
    state, events = add_parts(parts, noted)
    link = noted.groupBy(normalize_part_number(F.col("part_number")).alias("number")).agg(F.max_by("appliance_id", "seq").alias("_link"))
    before = parts.select(F.col("id").alias("_before"), F.col("appliance_id").alias("_had"))
    linked = state.join(link, state["part_number"] == link["number"], "left").join(before, F.col("id") == F.col("_before"), "left")
    return linked.withColumn("appliance_id", F.coalesce("_link", "_had")).drop("number", "_link", "_before", "_had"), events


def validate_rows(df: DataFrame, ruleset: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of add_part, deplete, update_part or appliance requests; rejected rows list their ``reasons``."""
    c = F.col
    long = lambda name, n: F.when(F.char_length(name) > n, F.lit(name))
    rules = {
        "add_part": [F.when(F.coalesce(F.char_length("part_number"), F.lit(0)).between(1, 50), None).otherwise(F.lit("part_number")), long("brand", 100), long("description", 500), F.when(c("quantity") < 1, F.lit("quantity")), long("note", 1000)],
        "deplete": [F.when(F.coalesce(c("quantity"), F.lit(0)) < 1, F.lit("quantity")), F.when(F.coalesce(c("reason").isin("used", "sold"), F.lit(False)), None).otherwise(F.lit("reason"))],
        "update_part": [long("brand", 100), long("description", 500), F.when(c("listed_quantity") < 0, F.lit("listed_quantity"))],
        "appliance": [long("brand", 100), long("model_number", 100), F.when(c("status").isNotNull() & ~c("status").isin("active", "stripped"), F.lit("status"))],
    }
    reasons = F.filter(F.array(*rules[ruleset]), lambda x: x.isNotNull())
    judged = df.withColumn("reasons", reasons)
    valid = judged.where(F.size("reasons") == 0).drop("reasons")
    if ruleset == "add_part":
        valid = valid.withColumn("quantity", F.coalesce("quantity", F.lit(1)))
    return valid, judged.where(F.size("reasons") > 0)
