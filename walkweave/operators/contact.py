"""Forward simulation of contact maps from walks.

All walks of all karyotypes are simulated in one job: steps get walk coordinates, tiles are placed on
them, tile pairs of a walk get a value from the decay model and are summed per reference pixel.  The
pair stage is quadratic in the tiles of one walk by definition; it is cut into block pairs so that a
long walk becomes many tasks, and pixels are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkweave.operators.skew import SMALL_ROWS, running_sum
from walkweave.sources.calibration import SYNTHETIC, Decay

#: steps per block of the pair stage
PAIR_STEPS = 256


def node_tiles(nodes: DataFrame, tiles: DataFrame, carry: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """Length and tiles of every node, one row a node, ``(node_id, nw, _tiles)``, hinted if small by count; and whether some
    nodes have no tile.

    A node partly outside the tiled region is as long as its tiles; one fully outside keeps its width and has no tiles.
    """
    by_node = Window.partitionBy("node_id").orderBy("tile_id")
    inner = tiles.select(
        "node_id", "tile_id", F.col("width").alias("tw"), *carry,
        (F.sum("width").over(by_node.rowsBetween(Window.unboundedPreceding, 0)) - F.col("width")).alias("off"),
    )
    packed = inner.groupBy("node_id").agg(
        F.sum("tw").alias("_tw"), F.array_sort(F.collect_list(F.struct("tile_id", "tw", "off", *carry))).alias("_tiles"))
    table = nodes.select("node_id", "width").join(packed, "node_id", "left").select("node_id", F.coalesce("_tw", "width").alias("nw"), "_tiles")
    seen = nodes.select("node_id", F.lit(0).alias("_t")).unionByName(tiles.select("node_id", F.lit(1).alias("_t"))).groupBy("node_id").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_t").alias("_t")).agg(F.sum("_c").alias("rows"), F.min("_t").alias("least")).first()
    small = (seen["rows"] or 0) <= SMALL_ROWS
    return (F.broadcast(table) if small else table), seen["least"] == 0


def place_tiles(steps: DataFrame, nodes: DataFrame, tiles: DataFrame, keys: Sequence[str] = ("walk_id",),
                split: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Steps with the walk length ``len`` and their tiles in walk coordinates, ``_at`` (tile_id, tw, mid, and what is carried
    from the tiles), null without tiles.

    Where the tiles leave nodes out, walks that meet no tile go first, before anything is summed along walks.
    """
    table, partial = node_tiles(nodes, tiles, carry)
    placed = steps.withColumn("node_id", F.abs("node")).join(table, "node_id")
    if partial:
        hit = placed.filter("_tiles IS NOT NULL").select(*keys).distinct()
        placed = placed.join(hit, list(keys), "left_semi")
    placed = running_sum(placed, keys, F.col("nw"), "_end", split=split)
    if split:
        total = placed.groupBy(*keys).agg(F.max("_end").alias("len"))
        placed = placed.join(total, list(keys))
    else:
        placed = placed.withColumn("len", F.max("_end").over(Window.partitionBy(*keys)))
    start = F.col("_end") - F.col("nw")

    def at(t: Column) -> Column:
        within = F.when(F.col("node") > 0, t["off"]).otherwise(F.col("nw") - t["off"] - t["tw"])
        return F.struct(t["tile_id"].alias("tile_id"), t["tw"].alias("tw"), (start + within + (t["tw"] + 1) / 2).alias("mid"),
                        *[t[c].alias(c) for c in carry])

    return placed.withColumn("_at", F.transform("_tiles", at)).drop("node_id", "_end", "nw", "node", "_tiles")


def walk_pixels(
    steps: DataFrame,
    nodes: DataFrame,
    tiles: DataFrame,
    by: Sequence[str] = (),
    keys: Sequence[str] = ("walk_id",),
    model: float = 0,
    decay: Decay = SYNTHETIC,
    split: bool = False,
    pair_steps: int = PAIR_STEPS,
    longest: int | None = None,
) -> DataFrame:
    """Within-walk contacts per reference pixel: ``(by, i, j, value)``, ``i <= j``, non-zero pixels only.

    ``model = 0`` uses the distance decay, a positive model is a mean read length.  A ``cn`` column on
    the steps multiplies a walk's contacts.  The tiles of a walk of up to ``pair_steps`` steps meet in one row of the walk;
    longer walks meet block by block.  ``longest`` bounds the steps of a walk from above, if known.
    """
    placed = place_tiles(steps, nodes, tiles, keys, split)
    placed = placed.withColumn("_cn", F.col("cn") if "cn" in steps.columns else F.lit(1))
    carry = list(dict.fromkeys([*by, *keys]))
    short = placed if longest is not None and longest <= pair_steps else placed.filter(F.col("n") <= pair_steps)
    # after the running sum the steps of a walk are together, so this takes no further exchange
    rows = short.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carry if c not in keys], *[F.first(c).alias(c) for c in ("circular", "len", "_cn")],
        F.flatten(F.collect_list("_at")).alias("_all"))
    pairs = rows.select("*", F.explode("_all").alias("_a")).select("*", F.explode("_all").alias("_b")).filter("_a.mid <= _b.mid")
    pairs = pairs.select(*by, "circular", "len", "_cn", *_pair("_a", "_b"))
    if longest is None or longest > pair_steps:
        pairs = pairs.unionByName(_block_pairs(placed.filter(F.col("n") > pair_steps), by, keys, carry, pair_steps))
    dist = F.col("mb") - F.col("ma")
    dist = F.when(F.col("circular"), F.least(dist, F.col("len") - dist)).otherwise(dist)
    pairs = pairs.withColumns({"d": dist, "area": F.col("wa").cast("double") * F.col("wb")})
    value = decay.contact(F.col("area"), F.col("d")) if model == 0 else decay.long_read(
        F.col("area"), F.col("d"), model)
    twice = F.when((F.col("p") == F.col("q")) & (F.col("ma") < F.col("mb")), 2).otherwise(1)
    return pairs.groupBy(*by, F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).agg(
        F.sum(value * twice * F.col("_cn")).alias("value")
    )


def _pair(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.tile_id").alias("p"), F.col(f"{a}.tw").alias("wa"), F.col(f"{a}.mid").alias("ma"),
            F.col(f"{b}.tile_id").alias("q"), F.col(f"{b}.tw").alias("wb"), F.col(f"{b}.mid").alias("mb")]


def _block_pairs(placed: DataFrame, by: Sequence[str], keys: Sequence[str], carry: list[str], pair_steps: int) -> DataFrame:
    """Pairs of tiles of long walks, by pairs of blocks of steps."""
    blk = F.floor((F.col("pos") - 1) / pair_steps)
    last = F.floor((F.col("n") - 1) / pair_steps)
    each = placed.withColumn("x", F.explode("_at"))
    a = each.select(*carry, "circular", "len", "_cn", F.col("x").alias("_a"), blk.alias("_ba"), F.explode(F.sequence(blk, last)).alias("_bb"))
    b = each.select(*keys, F.col("x").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), blk)).alias("_ba"), blk.alias("_bb"))
    met = a.join(b, [*keys, "_ba", "_bb"]).filter("_a.mid <= _b.mid")
    return met.select(*by, "circular", "len", "_cn", *_pair("_a", "_b"))


def template(tiles: DataFrame, interactions: bool = False) -> DataFrame:
    """All pixels ``(i, j, id, widthprod)`` of the upper triangle; ``id`` runs row by row.

    Each row lists its own partners from the tile count, and widths come from an equi-join.
    """
    count = F.lit(tiles.agg(F.max("tile_id")).first()[0])
    cols = ["tile_id", "width"] + (["compartment"] if interactions else [])
    left = tiles.select(*[F.col(c).alias(f"{c}_i") for c in cols])
    right = tiles.select(*[F.col(c).alias(f"{c}_j") for c in cols])
    grid = left.withColumn("tile_id_j", F.explode(F.sequence(F.col("tile_id_i"), count))).join(right, "tile_id_j")
    i, j = F.col("tile_id_i").cast("long"), F.col("tile_id_j").cast("long")
    out = [
        F.col("tile_id_i").alias("i"), F.col("tile_id_j").alias("j"),
        ((i - 1) * count - F.floor((i - 1) * (i - 2) / 2) + (j - i + 1)).alias("id"),
        (F.col("width_i").cast("double") * F.col("width_j")).alias("widthprod"),
    ]
    if interactions:
        out.append(interaction(F.col("compartment_i"), F.col("compartment_j")).alias("interaction"))
    return grid.select(*out)


def interaction(a: Column, b: Column) -> Column:
    """``same``/``diff`` compartments, NULL if either is unknown."""
    return F.when(a.isNull() | b.isNull(), None).when(a == b, "same").otherwise("diff")


def compartments(tiles: DataFrame, ranges: DataFrame, bin_width: int) -> DataFrame:
    """``A`` or ``B`` when more than half of a tile lies in that compartment and not in the other."""
    from walkweave.operators.intervals import overlap_join

    hit = overlap_join(tiles.select("tile_id", "seqnames", "start", "end", "width"),
                       ranges.select("seqnames", "start", "end", "compartment"), bin_width)
    part = lambda c: F.sum(F.when(F.col("compartment") == c, F.col("end") - F.col("start") + 1).otherwise(0))
    frac = hit.groupBy("tile_id", "width").agg((part("A") / F.col("width")).alias("a"), (part("B") / F.col("width")).alias("b"))
    kind = F.when((F.col("a") > 0.5) & (F.col("b") < 0.5), "A").when((F.col("a") < 0.5) & (F.col("b") > 0.5), "B")
    return tiles.join(frac.select("tile_id", kind.alias("compartment")), "tile_id", "left")


def background(grid: DataFrame, tiles: DataFrame, decay: Decay = SYNTHETIC) -> DataFrame:
    """Contacts between molecules: area x density x copy numbers, on every pixel."""
    on = lambda c: tiles.select(F.col("tile_id").alias(c), F.col("cn").alias(f"cn_{c}"))
    return grid.join(on("i"), "i").join(on("j"), "j").withColumn(
        "value", F.col("widthprod") * decay.interchrom * (F.col("cn_i") * F.col("cn_j"))
    ).drop("cn_i", "cn_j")


def simulate(
    steps: DataFrame,
    nodes: DataFrame,
    tiles: DataFrame,
    depth: float = 1,
    model: float = 0,
    interchrom: bool = True,
    keys: Sequence[str] = ("walk_id",),
    decay: Decay = SYNTHETIC,
    split: bool = False,
    longest: int | None = None,
) -> DataFrame:
    """Contact map of one set of walks over the whole template: ``(i, j, id, widthprod, value)``.

    ``depth`` counts both haplotypes, so half of it scales the map.
    """
    inside = walk_pixels(steps, nodes, tiles, (), keys, model, decay, split, longest=longest).withColumnRenamed("value", "_v")
    grid = template(tiles)
    grid = background(grid, tiles, decay) if interchrom and model == 0 else grid.withColumn("value", F.lit(0.0))
    return grid.join(inside, ["i", "j"], "left").withColumn(
        "value", (F.col("value") + F.coalesce("_v", F.lit(0.0))) * (depth / 2)
    ).drop("_v")


def symmetrize(pixels: DataFrame) -> DataFrame:
    """Full matrix from its upper triangle (the diagonal once)."""
    flip = pixels.filter("i <> j").withColumnsRenamed({"i": "_j", "j": "i"}).withColumnRenamed("_j", "j")
    return pixels.unionByName(flip)


def sum_maps(maps: DataFrame) -> DataFrame:
    return maps.groupBy("i", "j").agg(F.sum("value").alias("value"))


def coverage(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Contacts per tile; a diagonal pixel counts once."""
    ends = F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))
    return pixels.select(*by, F.explode(ends).alias("tile_id"), "value").groupBy(*by, "tile_id").agg(
        F.sum("value").alias("cov")
    )


def abc_scores(enhancers: DataFrame, promoters: DataFrame, pixels: DataFrame, tiles: DataFrame, bin_width: int,
               eps: float = 1e-12) -> DataFrame:
    """Activity-by-contact: ``(enhancer_id, gene, score)``, every gene's scores sum to one.

    Enhancers need ``enhancer_id, score``; promoters ``gene``.  The matrix is listed in both
    directions, so a diagonal pixel counts twice.
    """
    from walkweave.operators.intervals import overlap_join

    at = tiles.select("tile_id", "seqnames", "start", "end")
    e = overlap_join(at, enhancers, bin_width, "pairs").select(F.col("tile_id").alias("i"), "enhancer_id", F.col("score").alias("act"))
    p = overlap_join(at, promoters, bin_width, "pairs").select(F.col("tile_id").alias("j"), "gene")
    both = pixels.select("i", "j", "value").unionByName(
        pixels.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    # sum over the enhancer axis first: one row per (enhancer, tile) instead of one per pixel pair
    by_e = both.join(e, "i").groupBy("enhancer_id", "act", "j").agg(F.sum("value").alias("value"))
    mass = by_e.join(p, "j").groupBy("enhancer_id", "act", "gene").agg(F.sum("value").alias("value"))
    mass = mass.withColumn("raw", F.col("value") * F.col("act"))
    total = mass.groupBy("gene").agg(F.sum("raw").alias("_total"))
    return mass.join(total, "gene").select(
        "enhancer_id", "gene", (F.col("raw") / (F.col("_total") + eps)).alias("score")
    )


def listed_pixels(lists: DataFrame, kar: str, decay: Decay = SYNTHETIC) -> DataFrame:
    """:func:`walk_pixels` ``(kar, i, j, value)`` of karyotypes as lists of tiles, summed where they are: no shuffle."""
    # here, as lists and distances build on this module
    from walkweave.operators import lists as LI

    def each(ids, flat):
        px = LI.pixel_sums(flat, decay)
        return ids[px["row"]], px["i"], px["j"], px["a"]

    return LI.run_pairs(lists.select(kar, "walks"), f"{kar} long, i int, j int, value double", each, ("walks",))


def small_pixels(steps: DataFrame, nodes: DataFrame, tiles: DataFrame, by: str, keys: Sequence[str] = ("walk_id",), decay: Decay = SYNTHETIC,
                 split: bool = False, longest: int | None = None, **kw) -> DataFrame:
    """:func:`walk_pixels` by one whole-numbered column, whose values each own their walks: small ones as lists, others by rows."""
    from walkweave.operators import lists as LI

    lists, wide = LI.karyotype_lists(place_tiles(steps, nodes, tiles, keys, split), F.col("_at"), by, keys, **kw)
    made = listed_pixels(lists, by, decay)
    if wide is None:
        return made
    return made.unionByName(walk_pixels(steps.join(wide, by, "left_semi"), nodes, tiles, [by], keys, 0, decay, split, longest=longest))
