"""Long clips as rows of sample blocks: (id, block, samples), every block but a clip's last of the same size.

Nothing holds a whole clip: levels are sums over blocks, looped noise comes by an equi-join with the noise blocks that a main block runs
over (four at most), silence moves blocks and cuts them anew. An empty clip has no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from echoscore import constants as K

SIZE = 1 << 16


def blocks(clips: DataFrame, clip: str, size: int = SIZE, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Clips held as arrays, cut into blocks."""
    n = F.size(clip)
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.expr(f"(size(`{clip}`) - 1) div {size}").cast("int"))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(numbers, lambda b: F.slice(clip, b * size + 1, F.lit(size)))
    return clips.select(*keys, F.posexplode(cut).alias("block", "samples")).withColumn("block", F.col("block").cast("long"))


def levels(block_rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, n, rms, usable) per clip, from partial sums of its blocks."""
    squares = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    finite = F.forall("samples", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = block_rows.select(key, F.size("samples").cast("long").alias("n"), squares.alias("s"), finite.alias("finite"))
    whole = parts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.bool_and("finite").alias("finite"))
    rms = F.sqrt(F.try_divide("s", "n"))
    return whole.select(key, "n", rms.alias("rms"), F.coalesce(F.col("finite") & (rms > 0), F.lit(False)).alias("usable"))


def dbfs(level: DataFrame, key: str = "id") -> DataFrame:
    """(key, dbfs) from ``levels``: NULL for a silent clip."""
    return level.select(key, F.when(F.col("rms") > 0, 20 * F.log10("rms")).alias("dbfs"))


def mixed(main: DataFrame, noise: DataFrame, picks: DataFrame, size: int = SIZE, multiplier: float = K.NOISE_MULTIPLIER) -> DataFrame:
    """(id, block, samples) of main clips with their looped, scaled noise, limited to [-1, 1].

    ``main`` and ``noise`` (noise_id, block, samples) have blocks of ``size``, ``picks`` one (id, noise_id) per clip. Clips of which either
    cannot be mixed have no rows. Main blocks move once; a noise block is sent to each main block that runs over it.
    """
    factor = multiplier if multiplier > 0 else 10 ** (K.MUTED_DB / 20)
    loud = levels(main).where("usable").select("id", F.col("rms").alias("main_rms"))
    quiet = levels(noise, "noise_id").where("usable").select("noise_id", F.col("n").alias("period"), F.col("rms").alias("noise_rms"))
    gain = F.try_divide("main_rms", "noise_rms") * factor
    clip = picks.join(loud, "id").join(quiet, "noise_id").select("id", "noise_id", "period", gain.alias("gain"))
    runs = main.select("id", "block", F.size("samples").alias("n")).join(clip, "id")
    # samples first .. last of the looped noise, unwrapped once at its end
    first = (F.col("block") * size) % F.col("period")
    last = first + F.col("n") - 1
    end = F.expr(f"(period - 1) div {size}")
    wide = runs.select("id", "block", "noise_id", "period", "gain", first.alias("first"), last.alias("last"), end.alias("end"))
    upto = lambda c: F.expr(f"({c}) div {size}")
    wanted = F.when(F.col("period") <= size, F.array(F.lit(0).cast("long"))).when(
        F.col("last") < F.col("period"), F.sequence(upto("first"), upto("last"))
    ).otherwise(F.array_distinct(F.concat(F.sequence(upto("first"), F.col("end")), F.sequence(F.lit(0).cast("long"), upto("last - period")))))
    asked = wide.select("id", "block", "noise_id", "period", "gain", "first", F.explode(wanted).alias("part"))
    parts = asked.join(noise.select("noise_id", F.col("block").alias("part"), F.col("samples").alias("noise")), ["noise_id", "part"])
    heard = parts.groupBy("id", "block").agg(
        F.first("period").alias("period"), F.first("gain").alias("gain"), F.first("first").alias("first"),
        F.map_from_entries(F.collect_list(F.struct("part", "noise"))).alias("parts"),
    )

    def at(x: Column, j: Column) -> Column:
        place = (F.col("first") + j) % F.col("period")
        other = F.get(F.element_at("parts", F.floor(place / size)), (place % size).cast("int"))
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") + F.col("gain") * other)).cast("float")

    return main.join(heard, ["id", "block"]).select("id", "block", F.transform("samples", at).alias("samples"))


def with_silence(main: DataFrame, places: DataFrame, n: int, size: int = SIZE) -> DataFrame:
    """(id, position, block, samples) with ``n`` zero samples at each ``position`` (front, middle, back) of ``places`` (id, position)."""
    lengths = main.groupBy("id").agg(F.sum(F.size("samples")).cast("long").alias("total"))
    position = F.col("position")
    cut = (
        F.when(position == "front", F.lit(0)).when(position == "middle", F.expr("total div 2")).when(position == "back", F.col("total"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown position: "), F.coalesce(position, F.lit("NULL"))))).cast("long")
    )
    plan = places.join(lengths, "id").select("id", "position", cut.alias("cut"))
    start = F.col("block") * size
    stop = start + F.size("samples")
    rows = main.join(plan, "id")
    # what lies before the cut stays, what lies behind it moves on
    kept = rows.select("id", "position", start.alias("a"), F.least(stop, "cut").alias("b"), F.lit(0).cast("long").alias("skip"), "samples")
    moved = rows.select(
        "id", "position", (F.greatest(start, "cut") + n).alias("a"), (stop + n).alias("b"), (F.greatest(start, "cut") - start).alias("skip"), "samples")
    pieces = kept.unionByName(moved).where("a < b")
    numbers = F.sequence(F.expr(f"a div {size}"), F.expr(f"(b - 1) div {size}"))
    pieces = pieces.withColumn("to", F.explode(numbers))
    low, high = F.greatest("a", F.col("to") * size), F.least("b", (F.col("to") + 1) * size)
    sound = pieces.select("id", "position", F.col("to").alias("block"), low.alias("at"),
                          F.slice("samples", (F.col("skip") + low - F.col("a") + 1).cast("int"), (high - low).cast("int")).alias("part"))
    gap = plan.where(F.lit(n > 0)).select("id", "position", F.col("cut").alias("a"), (F.col("cut") + n).alias("b")).withColumn("to", F.explode(numbers))
    silence = gap.select("id", "position", F.col("to").alias("block"), low.alias("at"), F.array_repeat(F.lit(0.0).cast("float"), (high - low).cast("int")).alias("part"))
    joined = F.array_sort(F.collect_list(F.struct("at", "part")))
    whole = sound.unionByName(silence).groupBy("id", "position", "block").agg(joined.alias("parts"))
    return whole.select("id", "position", "block", F.flatten(F.transform("parts", lambda p: p["part"])).alias("samples"))
