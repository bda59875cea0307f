"""Problem 6: filling fixed-capacity containers with items.

Harmonic packing: an item of size s belongs to class j = floor(capacity / s), and j items of class j always fit one
container, so every container of a class takes a fixed number of items and classes are filled independently, shard by
shard.  Items larger than the capacity, and only those, are cut into pieces of the capacity and a rest.

Containers of the first classes leave room: one of class 1 may be almost half empty.  That room is offered as places
for items of the donor classes (sizes up to capacity / 4, / 8, ...): the places of a shard and its donor items are
both numbered, and an item takes the place with its own number.  Donors without a place are packed harmonically, and
the last, incomplete containers of all classes of a shard are filled up from one another, largest item first.

No step looks at more than one shard, and shards hold about ``shard_items`` items whatever the size of the input.

Defined results: an item without tokens (NULL or empty text) takes part with size 0 and class of the smallest items;
repeated ids are packed as separate items; an empty table gives no containers; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import shared_folder

#: Items of one shard, about.
SHARD_ITEMS = 50_000
#: Classes beyond this are one class of the smallest items.
CLASSES = 256
#: Classes whose containers offer their room to smaller items.
HOSTS = 3
#: Donor classes, largest items first: items of size in (capacity / 2d, capacity / d].
DONORS = (4, 8, 16, 32, 64)


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, size: whole items, and of items beyond the capacity full pieces and the rest."""
    size = F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint")
    last = F.greatest(F.ceil(size / capacity), F.lit(1)) - 1
    df = items.select("doc_id", size.alias("total"), F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece"))
    return df.select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).alias("size"))


def _numbered(df: DataFrame, within: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1)


def pack(items: DataFrame, capacity: int, shard_items: int = SHARD_ITEMS, classes: int = CLASSES) -> DataFrame:
    """doc_id, piece, size, container: every piece of every item in exactly one container of at most ``capacity``.

    ``items`` has doc_id and tokens.  ``container`` is a string that names the shard and the container within it.
    """
    cut = pieces(items, capacity)
    shards = max(1, round(cut.count() / shard_items))
    df = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    df = df.withColumn("class", F.least(F.floor(F.lit(capacity) / F.greatest("size", F.lit(1))), F.lit(classes)).cast("int"))
    # A number of the item within its shard tells repeated ids apart.
    # It is written once: numbers of ties must not change between the branches below.
    shared_folder(items.sparkSession)
    df = _numbered(df, ["shard"], [F.desc("size"), "doc_id", "piece"], "item").checkpoint()

    def in_classes(rows: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
        """Items in full containers of their class, and the fewer than j items each class j leaves over."""
        ranked = _numbered(rows, ["shard", "class"], [F.desc("size"), "item"], "rank")
        ranked = ranked.withColumn("of_class", F.count("*").over(Window.partitionBy("shard", "class")))
        whole = F.col("rank") < F.floor(F.col("of_class") / F.col("class")) * F.col("class")
        name = F.concat_ws("-", F.lit(mark), "class", F.floor(F.col("rank") / F.col("class")))
        return ranked.where(whole).select("shard", "item", name.alias("bin"), "size"), ranked.where(~whole).select("shard", "item", "size")

    hosts, left = in_classes(df.where(F.col("class") <= HOSTS).select("shard", "item", "class", "size"), "a")
    room = F.col("room")
    offers = []
    for d in DONORS:
        each = capacity // d
        offers.append(F.struct(F.lit(d).alias("donor"), F.floor(room / each).cast("int").alias("places")))
        room = room - F.floor(room / each) * each
    places = hosts.groupBy("shard", "bin").agg((F.lit(capacity) - F.sum("size")).alias("room"))
    places = places.select("shard", "bin", F.explode(F.array(*offers)).alias("o")).where("o.places > 0")
    places = places.select("shard", "bin", F.col("o.donor").alias("donor"), F.explode(F.sequence(F.lit(1), F.col("o.places"))).alias("k"))
    places = _numbered(places, ["shard", "donor"], ["bin", "k"], "number").select("shard", "donor", "number", "bin")

    small = df.where(F.col("class") > HOSTS).select("shard", "item", "class", "size")
    donor = F.coalesce(*[F.when(F.col("size") <= capacity // d, F.lit(d)) for d in reversed(DONORS)], F.lit(0))
    small = _numbered(small.withColumn("donor", donor), ["shard", "donor"], [F.desc("size"), "item"], "number")
    small = small.join(places, ["shard", "donor", "number"], "left")
    guests = small.where(F.col("bin").isNotNull()).select("shard", "item", "bin")
    full, more = in_classes(small.where(F.col("bin").isNull()).select("shard", "item", "class", "size"), "h")

    # Left over: fewer than j items of each class j, at most classes**2 / 2 a shard.
    ends = left.unionByName(more).groupBy("shard").applyInPandas(_first_fit(capacity), "shard int, item int, bin string")

    bins = hosts.drop("size").unionByName(guests).unionByName(full.drop("size")).unionByName(ends)
    out = df.join(bins, ["shard", "item"])
    return out.select("doc_id", "piece", "size", F.concat_ws("-", "shard", "bin").alias("container"))


def _first_fit(capacity: int):
    """First fit, largest first, of the few items a shard's classes leave over."""
    import pandas as pd

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "item"], ascending=[False, True])
        rooms: list[int] = []
        where = []
        for size in frame["size"].tolist():
            at = next((i for i, r in enumerate(rooms) if r >= size), len(rooms))
            if at == len(rooms):
                rooms.append(capacity)
            rooms[at] -= size
            where.append(f"r-{at}")
        return pd.DataFrame({"shard": frame["shard"], "item": frame["item"], "bin": where})

    return fill


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """container, pieces, tokens, unused."""
    per = packed.groupBy("container").agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens"))
    return per.withColumn("unused", F.lit(capacity) - F.col("tokens"))
