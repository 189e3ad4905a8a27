"""Operators on recognised text lines and their boxes.

Token tables have inspection_id, line_no (record order), text, confidence and
the box x1, y1, x2, y2 in page pixels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmark import constants as C
from panelmark.functions.text import has_any, is_barcode, text
from panelmark.operators import slices
from panelmark.session import cut, spread

ROW_GAP = 45.0
BOX = ["x1", "y1", "x2", "y2"]


# -------------------------------------------------------------- reading rows


def _row_cell() -> Column:
    # lower than the gap, so that a cell holds one start at most
    return F.floor(F.col("y1") / (ROW_GAP - 5))


def row_starts(tokens: DataFrame) -> DataFrame:
    """Upper edges that open a reading row: (inspection_id, _cell, _start, _before), the last counting the rows above the cell.

    Taken from top to bottom, a token opens a row when it lies more than the
    gap below the token that opened the row before. A step of more than the gap
    between two edges opens one whatever came before, so the page is cut there
    into islands and only the distinct edges of an island are folded. Edges are
    first reduced to cells lower than the gap, so ordering a page orders its
    cells, not its tokens.
    """
    page = Window.partitionBy("inspection_id").orderBy("_cell")
    cells = tokens.where("y1 IS NOT NULL").groupBy("inspection_id", _row_cell().alias("_cell")).agg(
        F.min("y1").alias("_top"), F.max("y1").alias("_low"), F.collect_set("y1").alias("_ys"))
    opens = F.coalesce(F.col("_top") - F.lag("_low").over(page) > ROW_GAP, F.lit(True)).cast("int")
    islands = cells.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(page))
    edges = islands.groupBy("inspection_id", "_island").agg(F.array_sort(F.flatten(F.collect_list("_ys"))).alias("_ys"))
    starts = F.aggregate(
        "_ys",
        F.array().cast("array<double>"),
        lambda kept, y: F.when(
            (F.size(kept) == 0) | (y - F.get(kept, F.size(kept) - 1) > ROW_GAP),
            F.concat(kept, F.array(y)),
        ).otherwise(kept),
    )
    opened = edges.select("inspection_id", F.explode(starts).alias("y1")).select("inspection_id", _row_cell().alias("_cell"), F.col("y1").alias("_start"))
    # a grouping, not a join: both sides are already dealt by package, and a null package stays one
    filled = cells.select("inspection_id", "_cell", F.lit(None).cast("double").alias("_start")).unionByName(opened)
    above = page.rowsBetween(Window.unboundedPreceding, -1)
    return filled.groupBy("inspection_id", "_cell").agg(F.max("_start").alias("_start")).withColumn(
        "_before", F.count("_start").over(above))


def reading_rows(tokens: DataFrame) -> DataFrame:
    """Adds ``row_no``, counted from 1 at the top of the page; 0 without an upper edge."""
    starts = row_starts(tokens).withColumnsRenamed({"inspection_id": "_id", "_cell": "_at"})
    placed = tokens.withColumn("_cell", _row_cell())
    joined = placed.join(spread(starts), F.col("inspection_id").eqNullSafe(F.col("_id")) & (F.col("_cell") == F.col("_at")), "left")
    opened = F.coalesce(F.col("y1") >= F.col("_start"), F.lit(False)).cast("int")
    row = F.coalesce(F.col("_before") + opened, F.lit(0)).cast("int")
    return joined.withColumn("row_no", row).drop("_cell", "_id", "_at", "_start", "_before")


def row_texts(rows: DataFrame) -> DataFrame:
    """Text of each reading row, tokens from left to right."""
    pieces = F.array_sort(F.collect_list(F.struct("x1", "line_no", "text")))
    return rows.groupBy("inspection_id", "row_no").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), " ").alias("row_text"),
        F.count("*").alias("tokens"),
    )


BLOCK = 512


def joined_text(df: DataFrame, key: str, order: str, column: str, name: str) -> DataFrame:
    """Texts of a key joined by newline in order, in two levels.

    Blocks of consecutive lines are joined first, so that no task sorts all
    lines of a large page; the last step only strings the blocks together.
    """
    block = F.floor(F.col(order) / BLOCK)
    parts = df.groupBy(key, block.alias("_block")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda p: p[column]), "\n"
        ).alias("_part")
    )
    return parts.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_block", "_part"))), lambda p: p["_part"]), "\n"
        ).alias(name)
    )


def full_text(tokens: DataFrame) -> DataFrame:
    return joined_text(tokens, "inspection_id", "line_no", "text", "full_text")


def reading_order(tokens: DataFrame) -> DataFrame:
    """Adds ``position``: by ten-pixel strip, then from left to right."""
    strip = F.floor(F.col("y1") / 10)
    order = [F.col("_strip"), F.col("x1"), F.col("line_no")]
    return slices.running_position(
        tokens.withColumn("_strip", strip), ["inspection_id"], order, "position"
    ).drop("_strip")


def tax_neighbourhood(rows: DataFrame, is_price: Column, is_tax: Column, reach: int = 5) -> DataFrame:
    """Price rows with the tax phrase near by, else anywhere in the package.

    Tax rows are spread to the rows they cover, which makes it an equi join.
    """
    prices = rows.where(is_price)
    taxes = rows.where(is_tax).select("inspection_id", F.col("row_no").alias("_tax_row"))
    covered = taxes.select(
        "inspection_id",
        F.explode(F.sequence(F.col("_tax_row") - reach, F.col("_tax_row") + reach)).alias("row_no"),
    ).distinct().withColumn("near", F.lit(True))
    anywhere = taxes.select("inspection_id").distinct().withColumn("anywhere", F.lit(True))
    joined = prices.join(spread(covered), ["inspection_id", "row_no"], "left").join(
        spread(anywhere), "inspection_id", "left"
    )
    return joined.withColumn("near", F.coalesce("near", F.lit(False))).withColumn(
        "tax_found", F.col("near") | F.coalesce("anywhere", F.lit(False))
    ).drop("anywhere")


# ------------------------------------------------------------- deduplication


def grid_dedup(tokens: DataFrame, cell: int = 15) -> DataFrame:
    """One token per (lower-case text, cell of its centre): the first one."""
    cx = F.floor(F.floor((F.col("x1") + F.col("x2")) / 2) / cell)
    cy = F.floor(F.floor((F.col("y1") + F.col("y2")) / 2) / cell)
    row = F.struct(*[F.col(c) for c in tokens.columns])
    kept = (
        tokens.where(F.trim(text("text")) != "")
        .groupBy("inspection_id", F.lower(F.trim("text")).alias("_t"), cx.alias("_cx"), cy.alias("_cy"))
        .agg(F.min_by(row, F.struct("line_no", "confidence")).alias("_row"))
    )
    return kept.select("_row.*")


def _overlap(a: Column, b: Column) -> Column:
    width = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    height = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((width > 0) & (height > 0), width * height).otherwise(0.0)


def _area(a: Column) -> Column:
    return F.greatest(F.lit(1.0), (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]))


def _suppresses(a: Column, b: Column) -> Column:
    shared = _overlap(a, b)
    union = F.greatest(F.lit(1.0), _area(a) + _area(b) - shared)
    of_smaller = shared / F.least(_area(a), _area(b))
    same = F.upper(a["text"]) == F.upper(b["text"])
    return (shared > 0) & ((shared / union >= 0.45) | (of_smaller > 0.65) | (same & (of_smaller > 0.25)))


#: reads of a page that are folded at once; more are settled in rounds
PAGE = 128
#: best reads of a cell that a round looks at
LEADERS = 32


def _matched(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join on equal ``names``, null being a value like any other; of the right only its other columns stay."""
    right = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"_right_{n}")) for n in names]
    joined = left.join(spread(right), reduce(lambda a, b: a & b, same), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{n}" for n in names])


def _folded(reads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _item) that stay on small pages: the list of a page is folded, best first."""
    lists = reads.groupBy(*keys).agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    kept = F.aggregate(
        "_items",
        F.slice("_items", 1, 0),
        lambda done, t: F.when(F.exists(done, lambda k: _suppresses(t, k)), done).otherwise(F.concat(done, F.array(t))),
    )
    return lists.select(*keys, F.explode(kept).alias("_item"))


def _settled(reads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _item) that stay on pages of any size, settled in rounds.

    Reads are placed in the cells of a grid as wide and high as the page's
    average box; two that overlap share a cell. A read that is among the
    ``LEADERS`` best undecided ones of all its cells meets there whatever better
    read could remove it. If none does it stays, and what it suppresses goes.
    The best undecided read of a page is always settled, so rounds end; there
    are about as many as the longest chain of reads of which each suppresses
    the next. Work of a round is linear in the undecided reads, and no cell
    gathers more than its leaders.
    """
    box = {b: F.col(f"_item.{b}") for b in BOX}
    solid = F.coalesce((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), F.lit(False))
    sizes = reads.where(solid).groupBy(*keys).agg(
        F.greatest(F.lit(1.0), F.avg(box["x2"] - box["x1"])).alias("_w"), F.greatest(F.lit(1.0), F.avg(box["y2"] - box["y1"])).alias("_h"))

    def span(low: str, high: str, step: str) -> Column:
        return F.sequence(F.floor(box[low] / F.col(step)), F.floor(box[high] / F.col(step)))

    across, down = span("x1", "x2", "_w"), span("y1", "y2", "_h")
    placed = _matched(reads.where(solid), sizes, keys, "inner").select(
        *keys, "_item", (F.size(across) * F.size(down)).alias("_cells"), across.alias("_xs"), down.alias("_ys"))
    placed = cut(placed.select(*keys, "_item", "_cells", F.explode("_xs").alias("_cx"), "_ys").select(
        *keys, "_item", "_cells", "_cx", F.explode("_ys").alias("_cy")))
    stay, cell = reads.where(~solid).select(*keys, "_item"), [*keys, "_cx", "_cy"]
    while not placed.isEmpty():
        place = F.row_number().over(Window.partitionBy(*cell).orderBy("_item"))
        leaders = placed.withColumn("_place", place).where(F.col("_place") <= LEADERS).groupBy(*cell).agg(
            F.collect_list(F.struct("_item", "_cells")).alias("_all"))
        beaten = F.exists("_all._item", lambda a: (a < F.col("_one._item")) & _suppresses(a, F.col("_one._item")))
        kept = cut(leaders.select(*cell, "_all", F.explode("_all").alias("_one"))
                   .select(*cell, F.col("_one._item").alias("_item"), F.col("_one._cells").alias("_cells"), beaten.alias("_beaten"))
                   .groupBy(*keys, "_item").agg(F.count("*").alias("_seen"), F.first("_cells").alias("_cells"), F.max("_beaten").alias("_beaten"),
                                                F.collect_list(F.struct("_cx", "_cy")).alias("_at"))
                   .where("_seen = _cells AND NOT _beaten"))
        winners = kept.select(*keys, "_item", F.explode("_at").alias("_at")).groupBy(*keys, F.col("_at._cx").alias("_cx"), F.col("_at._cy").alias("_cy")).agg(
            F.collect_list("_item").alias("_winners"))
        out = F.exists("_winners", lambda k: (k == F.col("_item")) | _suppresses(k, F.col("_item")))
        decided = _matched(placed, winners, cell, "inner").where(out).select(*keys, "_item").distinct()
        placed, stay = cut(_matched(placed, decided, [*keys, "_item"], "left_anti")), stay.unionByName(kept.select(*keys, "_item"))
    return stay


def nms_dedup(tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Greedy removal of overlapping reads, the most confident first.

    Repeats of one text in one box first leave only the best. Small pages are
    then folded in order, larger ones settled in rounds; both give the greedy
    result.
    """
    keys = keys or ["inspection_id"]
    tokens = tokens.where(F.trim(text("text")) != "")
    rank = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("line_no"), F.col("pass_no"))
    row = F.struct(*[F.col(c) for c in tokens.columns])
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    # degenerate boxes never overlap, so they are kept apart by their own id
    apart = F.when(flat, F.struct("line_no", "pass_no"))
    item = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("line_no"), F.col("pass_no"), *[F.col(b) for b in BOX],
                    F.trim("text").alias("text"))
    best = cut(
        tokens.withColumn("_rank", rank)
        .groupBy(*keys, *BOX, F.upper(F.trim("text")).alias("_t"), apart.alias("_apart"))
        .agg(F.min_by(row, "_rank").alias("_row"))
        .select("_row.*").withColumn("_item", item)
    )
    reads = best.select(*keys, "_item")
    large = reads.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > PAGE).drop("_n")
    if large.isEmpty():
        stay = _folded(reads, keys)
    else:
        large = cut(large)
        stay = _folded(_matched(reads, large, keys, "left_anti"), keys).unionByName(
            _settled(_matched(reads, large, keys, "left_semi"), keys))
    return _matched(best, stay, [*keys, "_item"], "left_semi").drop("_item")


# -------------------------------------------------------- coordinate changes


def union_passes(passes: list[tuple[DataFrame, float, float]]) -> DataFrame:
    """Union of several reads, crop coordinates moved to page coordinates."""
    moved = []
    for number, (tokens, dx, dy) in enumerate(passes):
        moved.append(
            tokens.withColumns(
                {
                    "x1": F.col("x1") + dx,
                    "x2": F.col("x2") + dx,
                    "y1": F.col("y1") + dy,
                    "y2": F.col("y2") + dy,
                    "pass_no": F.lit(number),
                }
            )
        )
    result = moved[0]
    for more in moved[1:]:
        result = result.unionByName(more)
    return result


def rotate_back(tokens: DataFrame, rotation: str, scale: Column, height: Column, width: Column) -> DataFrame:
    """Boxes of a turned and scaled read in page space; corners stay sorted."""

    def corner(x: str, y: str) -> tuple[Column, Column]:
        px, py, turn = F.col(x), F.col(y), F.col(rotation)
        across = F.when(turn == 90, py / scale).when(turn == 270, (width - 1 - py) / scale).otherwise(px / scale)
        down = F.when(turn == 90, (height - 1 - px) / scale).when(turn == 270, px / scale).otherwise(py / scale)
        return across, down

    (ax, ay), (bx, by) = corner("x1", "y1"), corner("x2", "y2")
    turned = F.struct(
        F.least(ax, bx).alias("x1"), F.least(ay, by).alias("y1"),
        F.greatest(ax, bx).alias("x2"), F.greatest(ay, by).alias("y2"),
    )
    keep = [c for c in tokens.columns if c not in BOX]
    return tokens.select(*keep, turned.alias("_b")).select(*keep, "_b.*")


# --------------------------------------------------------------- box matching


BOX_CELL = 256


def unmapped_tokens(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """Tokens that no declared box covers by more than half.

    A box that covers more than half of a token holds its centre. So boxes are
    laid out over the cells of a grid, as far as the package has tokens, and a
    token meets only those in the cell of its centre.
    """
    def cell(at: Column) -> Column:
        return F.floor(at / BOX_CELL)

    cx, cy = cell((F.col("x1") + F.col("x2")) / 2), cell((F.col("y1") + F.col("y2")) / 2)
    page = tokens.groupBy(F.col("inspection_id").alias("_page")).agg(
        F.min(cx).alias("_left"), F.max(cx).alias("_right"), F.min(cy).alias("_top"), F.max(cy).alias("_low"))
    b = boxes.select(F.col("inspection_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in BOX]).where(
        "_x1 IS NOT NULL AND _y1 IS NOT NULL AND _x2 > _x1 AND _y2 > _y1").distinct()

    def span(low: str, high: str, first: str, last: str) -> Column:
        # a pixel more on both sides, for centres that rounding moved
        start, end = F.greatest(cell(F.col(low) - 1), F.col(first)), F.least(cell(F.col(high) + 1), F.col(last))
        return F.when(start <= end, F.sequence(start, end))

    laid = b.join(spread(page), F.col("_id") == F.col("_page")).select(
        "_id", *[f"_{c}" for c in BOX], F.explode(span("_x1", "_x2", "_left", "_right")).alias("_cx"), span("_y1", "_y2", "_top", "_low").alias("_ys"))
    laid = laid.select("_id", *[f"_{c}" for c in BOX], "_cx", F.explode("_ys").alias("_cy"))
    width = F.least(F.col("x2"), F.col("_x2")) - F.greatest(F.col("x1"), F.col("_x1"))
    height = F.least(F.col("y2"), F.col("_y2")) - F.greatest(F.col("y1"), F.col("_y1"))
    own = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    covered = (width > 0) & (height > 0) & (own > 0) & (width * height > 0.5 * own)
    met = (F.col("inspection_id") == F.col("_id")) & (cx == F.col("_cx")) & (cy == F.col("_cy"))
    return tokens.join(spread(laid), met & covered, "left_anti")


def _packed(column: Column) -> Column:
    return F.upper(F.regexp_replace(column, "[^A-Za-z0-9]", ""))


def _long_words(column: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(column), F.lit("[A-Z0-9]{3,}"), F.lit(0)))


def token_intersection(decl: DataFrame, tokens: DataFrame) -> DataFrame:
    """Values and lines of a package that share words: how many, and which part of the value's words.

    An equi join on (package, word), so only pairs with something in common are made.
    """
    said = decl.select("inspection_id", "field_name", _long_words(text("value")).alias("_words"))
    said = said.select("inspection_id", "field_name", F.size("_words").alias("_n"), F.explode("_words").alias("_word"))
    read = tokens.select("inspection_id", "line_no", F.explode(_long_words(text("text"))).alias("_word"))
    shared = said.join(spread(read), ["inspection_id", "_word"]).groupBy("inspection_id", "field_name", "line_no").agg(
        F.count("*").alias("common"), F.first("_n").alias("_n"))
    return shared.select("inspection_id", "field_name", "line_no", "common", (F.col("common") / F.col("_n")).alias("ratio"))


VALUES = 64


def _pieces(column: Column) -> Column:
    """Distinct pieces of up to three characters of a text, the empty one included."""
    def of(length: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(column) - (length - 1))
        return F.when(F.length(column) >= length, F.transform(starts, lambda at: F.substring(column, at, F.lit(length)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(F.lit("")), of(1), of(2), of(3)))


def _inside(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Ids (_n, _h) of texts of a package where a needle may lie in a hay; none that does is missing.

    Hays are indexed by their pieces, a needle is looked up by that piece of
    three characters (a shorter needle: by itself) that the fewest hays of the
    package have.
    """
    indexed = hays.select("inspection_id", "_h", F.explode(_pieces(F.col("_text"))).alias("_key"))
    asked = F.when(F.length("_text") < 3, F.array("_text")).otherwise(F.filter(_pieces(F.col("_text")), lambda k: F.length(k) == 3))
    offered = needles.where(F.col("_text").isNotNull()).select("inspection_id", "_n", F.explode(asked).alias("_key"))
    held = indexed.groupBy("inspection_id", "_key").agg(F.count("*").alias("_hays"))
    # a piece that no hay has finds none
    rarest = offered.join(spread(held), ["inspection_id", "_key"], "left").groupBy("inspection_id", "_n").agg(
        F.min_by("_key", F.struct(F.coalesce("_hays", F.lit(0)), "_key")).alias("_key"))
    return rarest.join(spread(indexed), ["inspection_id", "_key"]).select("_n", "_h")


def _text_pairs(values: DataFrame, reads: DataFrame, into_line: list[tuple[str, str]], into_value: list[tuple[str, str]],
                words: tuple[Column, Column]) -> DataFrame:
    """Pairs of a value and a line of one package that a scorer has to see.

    In a package of up to ``VALUES`` values a line meets all of them, which is
    linear in the lines. In a larger one rows of equal texts are put together first (``_said`` and
    ``_seen`` count them, the first line stands for its copies), and a pair must
    have something to score: a text of ``into_line`` (value, line) in the line,
    one of ``into_value`` (line, value) in the value, or a word in common. Texts
    are found through an index of their pieces and words by equi joins, so the
    rows of such a package are spread by piece. Columns that hold null are not
    looked up.
    """
    values, reads = values.withColumn("_said", F.lit(1)), reads.withColumn("_seen", F.lit(1))
    large = values.groupBy("inspection_id").agg(F.count("*").alias("_n")).where(F.col("_n") > VALUES).select("inspection_id")
    if large.isEmpty():
        return values.join(spread(reads), "inspection_id")
    large = spread(cut(large))
    small = values.join(large, "inspection_id", "left_anti").join(spread(reads), "inspection_id")
    # the ids are fixed once they are written
    said = values.join(large, "inspection_id", "left_semi").groupBy(*[c for c in values.columns if c != "_said"]).agg(F.count("*").alias("_said"))
    said = cut(said.withColumn("_a", F.monotonically_increasing_id()))
    boxes = {"x1": F.min("x1"), "y1": F.min("y1"), "x2": F.max("x2"), "y2": F.max("y2")}
    kept = ["line_no", "confidence", "_box", "_seen", *BOX]
    read = reads.join(large, "inspection_id", "left_semi").groupBy(*[c for c in reads.columns if c not in kept]).agg(
        F.min("line_no").alias("line_no"), F.min_by("confidence", "line_no").alias("confidence"), F.min_by("_box", "line_no").alias("_box"),
        F.count("*").alias("_seen"), *[edge.alias(name) for name, edge in boxes.items()])
    read = cut(read.withColumn("_b", F.monotonically_increasing_id()))

    def texts(table: DataFrame, row: str, column: str, name: str) -> DataFrame:
        return table.select("inspection_id", F.col(row).alias(name), F.col(column).alias("_text"))

    found = [_inside(texts(said, "_a", a, "_n"), texts(read, "_b", b, "_h")).toDF("_a", "_b") for a, b in into_line]
    found += [_inside(texts(read, "_b", b, "_n"), texts(said, "_a", a, "_h")).toDF("_b", "_a").select("_a", "_b") for b, a in into_value]
    said_words = said.select("inspection_id", "_a", F.explode(words[0]).alias("_word"))
    read_words = read.select("inspection_id", "_b", F.explode(words[1]).alias("_word"))
    found.append(said_words.join(spread(read_words), ["inspection_id", "_word"]).select("_a", "_b"))
    met = reduce(DataFrame.unionByName, found).distinct()
    pairs = met.join(spread(said), "_a").join(spread(read.drop("inspection_id")), "_b").select(small.columns)
    return small.unionByName(pairs)


def evidence_match(decl: DataFrame, tokens: DataFrame) -> DataFrame:
    """Best token for each declared value, with the merged box of all matches."""
    number = F.coalesce(F.regexp_extract(F.regexp_extract(F.trim("value"), r"[0-9]+(?:[.,][0-9]+)?", 0), r"^[^.]*", 0), F.lit(""))
    values = decl.where(F.col("value").rlike("[A-Za-z0-9]")).select(
        "inspection_id", "field_name", _packed(F.trim("value")).alias("_v"), _long_words(F.trim("value")).alias("_vw"),
        F.when(F.length(number) >= 2, number).alias("_num"),
    )
    margin = (F.col("y1") < 25) & (((F.col("y2") - F.col("y1")) < 40) | ((F.col("x2") - F.col("x1")) > 400))
    squeezed = F.upper(F.regexp_replace(F.trim("text"), r"[^\p{L}\p{N}_]", ""))
    reads = tokens.where(F.col("text").rlike(r"[\p{L}\p{N}_]") & F.col("x1").isNotNull()).where(~margin).select(
        "inspection_id", "line_no", "confidence", *BOX, F.struct(*BOX).alias("_box"), squeezed.alias("_d"),
        F.upper(F.trim("text")).alias("_up"), _long_words(F.trim("text")).alias("_dw"), F.when(F.length(squeezed) >= 3, squeezed).alias("_long"),
    )
    pairs = _text_pairs(values, reads, [("_v", "_d"), ("_num", "_d"), ("_num", "_up")], [("_long", "_v")], (F.col("_vw"), F.col("_dw")))
    shared = F.size(F.array_intersect("_vw", "_dw"))
    score = (
        F.when(F.col("_v") == F.col("_d"), 3.0)
        .when(F.expr("contains(_d, _v)"), 2.0)
        .when(F.expr("contains(_v, _long)"), 1.5)
        .when(F.expr("contains(_d, _num) OR contains(_up, _num)"), 1.8)
        .when(shared > 0, 1.0 + shared / F.size("_vw"))
    )
    scored = pairs.withColumn("score", score).where("score IS NOT NULL")
    best = F.struct((-F.col("score")).alias("s"), F.col("line_no"))
    return scored.groupBy("inspection_id", "field_name").agg(
        F.max("score").alias("score"),
        F.min_by("confidence", best).alias("confidence"),
        F.min_by("line_no", best).alias("line_no"),
        F.min("x1").alias("x1"),
        F.min("y1").alias("y1"),
        F.max("x2").alias("x2"),
        F.max("y2").alias("y2"),
        F.sum(F.col("_said") * F.col("_seen")).alias("matches"),
    )


def evidence_fallback(checks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Simpler scorer for checks that still lack a box."""
    def squeezed(column: Column) -> Column:
        return F.upper(F.regexp_replace(column, r"[^\p{L}\p{N}_]", ""))

    def words(name: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.col(name), F.lit("[A-Z0-9]{3,}"), F.lit(0)))

    values = checks.where(text("observed") != "").select(
        "inspection_id", "rule_id", squeezed(F.trim("observed")).alias("_v"),
        F.nullif(F.regexp_extract(F.trim("observed"), r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).alias("_num"),
    )
    reads = tokens.where(F.col("text").rlike(r"[\p{L}\p{N}_]") & F.col("x1").isNotNull()).select(
        "inspection_id", "line_no", "confidence", *BOX, F.struct(*BOX).alias("_box"), squeezed(F.trim("text")).alias("_d"), F.trim("text").alias("_text"))
    pairs = _text_pairs(values, reads, [("_v", "_d"), ("_num", "_d"), ("_num", "_text")], [("_d", "_v")], (words("_v"), words("_d")))
    ratio = F.try_divide(F.size(F.array_intersect(words("_v"), words("_d"))), F.size(words("_v")))
    score = (
        F.when(F.expr("contains(_d, _v) OR contains(_v, _d)"), 2.0)
        .when(F.expr("contains(_d, _num) OR contains(_text, _num)"), 1.5)
        .otherwise(ratio)
    )
    scored = pairs.withColumn("score", score).where("score > 0")
    best = F.struct((-F.col("score")).alias("s"), F.col("line_no"))
    return scored.groupBy("inspection_id", "rule_id").agg(
        F.max("score").alias("score"),
        F.min_by("line_no", best).alias("line_no"),
        F.min_by("_box", best).alias("box"),
    )


def box_fallback(checks: DataFrame, decl: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """A missing box is taken from related fields, best first."""
    boxes = decl.where("x1 IS NOT NULL").select(
        "inspection_id", F.col("field_name").alias("candidate"), F.struct(*BOX).alias("_box"), "image_index"
    )
    offered = boxes.join(fallbacks, "candidate")
    best = offered.groupBy("inspection_id", "field").agg(
        F.min_by(F.struct("_box", "image_index"), "priority").alias("_best")
    )
    joined = checks.join(
        spread(best.withColumnRenamed("field", "_field").withColumnRenamed("inspection_id", "_id")),
        (F.col("inspection_id") == F.col("_id")) & (F.lower("field_name") == F.col("_field")),
        "left",
    )
    return joined.withColumn("from_fallback", F.col("box").isNull() & F.col("_best").isNotNull()).withColumn(
        "box", F.coalesce("box", "_best._box")
    ).drop("_id", "_field", "_best")


# ------------------------------------------------------------- spatial pairs

CELL_X, CELL_Y = 250, 150


def _near(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """Key/token pairs in touching grid cells: an equi join, not all pairs."""
    cells = keys.withColumn(
        "_gx", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                     lambda d: F.floor(F.col("kx") / CELL_X) + d))
    ).withColumn(
        "_gy", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                     lambda d: F.floor(F.col("ky") / CELL_Y) + d))
    )
    placed = tokens.withColumn("_gx", F.floor(F.col("x1") / CELL_X)).withColumn(
        "_gy", F.floor(F.col("y1") / CELL_Y)
    )
    return placed.join(spread(cells), ["inspection_id", "_gx", "_gy"]).drop("_gx", "_gy")


_PACKING = r"(?i)PACKAGING|PACKING|MFG|MFD"
_RELATIVE = r"(?i)(?:BEST\s*BEFORE|MONTHS?\s*FROM)"
_BATCH_KEY = r"(?i)BATCH|LOT|B\.NO"
_BATCH_NOISE = r"(?i)(?:BEST|BEFORE|BEBE|EXPORT|QUALITY|NET|WEIGHT|PACKED|MFG|INGREDIENT)"
_AMOUNT = (r"(?i)\b[0-9]+(?:[.,][0-9]+)?\s*(?:g|gm|gms|gram|grams|kg|kgs|ml|l|ltr|litres|mg|kcal|m|cm|mm|"
           r"sq\.m|n|pcs|units?|count)\b")


def _letters(column: Column) -> Column:
    return F.upper(F.regexp_replace(column, "[^A-Za-z]", ""))


def spatial_pair(
    tokens: DataFrame, key: str, value: str, exclude: str | None = None, own_line: str | None = None
) -> DataFrame:
    """Value for a key phrase: on its own line, else the cheapest neighbour.

    The first key (in record order) that gives a value wins. ``own_line``
    limits which key phrases may take a value from their own line. Patterns
    must not hold capturing groups.
    """
    key_rx, value_rx = f"(?i){key}", f"(?i){value}"
    keyed = tokens.where(F.col("text").rlike(key_rx)).select(
        "inspection_id",
        F.col("line_no").alias("key_line"),
        F.col("text").alias("key_text"),
        F.col("x1").alias("kx"),
        F.col("y1").alias("ky"),
        F.col("confidence").alias("key_confidence"),
        F.struct(*BOX).alias("key_box"),
        F.upper(F.regexp_extract("text", key_rx, 0)).alias("_key"),
    )
    prefix = F.get(F.split(F.col("key_text"), key_rx, 2), F.lit(0))
    packing = F.col("_key").rlike(_PACKING)
    keyed = keyed.where(~(packing & prefix.rlike(_RELATIVE)))
    batch = F.col("_key").rlike(_BATCH_KEY)

    own = F.trim(F.regexp_extract("key_text", rf"(?i)(?:{key})[:\s.\-]+({value})", 1))
    own_ok = (F.lit(True) if own_line is None else F.col("_key").rlike(own_line)) & (
        (own != "") & ~_letters(own).isin(C.STOP_WORDS) & ~is_barcode(own) & ~(packing & own.rlike(_RELATIVE))
    )
    same_line = keyed.where(own_ok).select(
        "inspection_id", "key_line", F.lit(-1.0).alias("cost"), F.col("key_line").alias("value_line"),
        own.alias("value"), F.col("key_confidence").alias("confidence"), F.col("key_box").alias("box"),
    )

    pairs = _near(tokens, keyed).where("line_no <> key_line")
    shown = F.col("text")
    fits = ~_letters(shown).isin(C.STOP_WORDS)
    if exclude:
        fits = fits & ~shown.rlike(f"(?i){exclude}")
    batch_bad = (
        is_barcode(shown) | (F.col("confidence") < 85.0) | shown.rlike(_BATCH_NOISE)
        | F.trim(shown).rlike(r"(?i)^[0-9]+\s*(?:g|gm|kg|ml|l|m|cm|mm)$")
    )
    fits = fits & ~(batch & batch_bad) & ~(packing & shown.rlike(_RELATIVE))
    dx, dy = F.col("x1") - F.col("kx"), F.col("y1") - F.col("ky")
    ax, ay = F.abs(dx), F.abs(dy)
    cost = (
        F.when((ax <= 25) & (ay <= 150), ax * 5.0 + ay * 0.5)
        .when((dx > 0) & (ay <= 40) & (dx <= 250), 10.0 + ay * 2.0 + dx * 0.5)
        .when((dy > 0) & (dy <= 90) & (ax <= 50), 20.0 + dy * 1.2 + ax)
        .when((dy > 0) & (dy <= 140) & (ax <= 120), 40.0 + dy + ax * 1.5)
        .when((dy < 0) & (dy >= -90) & (ax <= 50), 30.0 - dy + ax * 1.2)
    )
    taken = F.trim(F.regexp_extract("text", value_rx, 0))
    number = taken.rlike(r"\b[12][0-9]{13}\b") | F.lower(taken).contains("lic") | F.lower(taken).contains("fssai")
    late = F.col("_key").rlike(_PACKING + "|PACKED") & (
        shown.rlike(_RELATIVE) | taken.rlike("(?i)(?:MONTHS?|DAYS?|WEEKS?)")
    )
    good = (
        (taken != "") & ~_letters(taken).isin(C.STOP_WORDS) & ~is_barcode(taken) & ~is_barcode(shown)
        & ~number & ~(batch & (taken.rlike(_AMOUNT) | taken.rlike(_BATCH_NOISE))) & ~late
    )
    neighbours = pairs.where(fits).withColumn("cost", cost).where("cost IS NOT NULL").where(good).select(
        "inspection_id", "key_line", "cost", F.col("line_no").alias("value_line"), taken.alias("value"),
        "confidence", F.struct(*BOX).alias("box"),
    )
    found = same_line.unionByName(neighbours)
    best = F.struct("key_line", "cost", "value_line")
    return found.groupBy("inspection_id").agg(
        F.min_by(F.struct("value", "confidence", "box", "key_line", "value_line"), best).alias("_f")
    ).select("inspection_id", "_f.*")


def below_anchor(tokens: DataFrame, anchor: str) -> DataFrame:
    """Text right below an anchor phrase; pieces of that line are joined."""
    keys = tokens.where(F.col("text").rlike(anchor)).select(
        "inspection_id", F.col("line_no").alias("key_line"), F.col("x1").alias("kx"), F.col("y1").alias("ky")
    )
    pairs = _near(tokens, keys).where(
        "line_no <> key_line AND y1 - ky > 0 AND y1 - ky <= 90 AND abs(x1 - kx) <= 75 AND length(text) > 2"
    )
    first = pairs.groupBy("inspection_id").agg(
        F.min_by(
            F.struct("key_line", F.col("y1").alias("first_y"), F.col("text").alias("first_text"),
                     F.col("confidence").alias("first_confidence"), F.struct(*BOX).alias("first_box")),
            F.struct("key_line", F.expr("y1 - ky"), "line_no"),
        ).alias("_f")
    ).select("inspection_id", "_f.*")
    skip = "^(" + "|".join(C.MAKER_ROW_SKIP) + ")"
    row = pairs.join(spread(first), ["inspection_id", "key_line"]).where(
        (F.abs(F.col("y1") - F.col("first_y")) <= 12) & ~F.upper("text").rlike(skip)
    )
    pieces = row.groupBy("inspection_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("x1", "line_no", "text"))), lambda p: p["text"]), " "
        ).alias("_maker"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )
    joined = first.join(spread(pieces), "inspection_id", "left")
    return joined.select(
        "inspection_id",
        F.coalesce("_maker", "first_text").alias("maker"),
        F.col("first_confidence").alias("confidence"),
        *[F.coalesce(c, f"first_box.{c}").alias(c) for c in BOX],
    )


def continuation_lines(rows: DataFrame, anchors: DataFrame, stop: str) -> DataFrame:
    """Row texts after each anchor row up to the next stop row.

    ``rows``: inspection_id, row_no, row_text. ``anchors``: inspection_id,
    anchor_line, anchor_row. The end is found with an aggregate, not a window.
    """
    after = anchors.join(spread(rows), "inspection_id").where(
        (F.col("row_no") > F.col("anchor_row")) & (F.trim("row_text") != "")
    )
    halted = after.withColumn("_stop", F.col("row_text").rlike(stop))
    ends = halted.groupBy("inspection_id", "anchor_line").agg(
        F.min(F.when(F.col("_stop"), F.col("row_no"))).alias("_end")
    )
    kept = halted.join(spread(ends), ["inspection_id", "anchor_line"]).where(
        F.col("_end").isNull() | (F.col("row_no") < F.col("_end"))
    )
    pieces = F.array_sort(F.collect_list(F.struct("row_no", F.trim("row_text").alias("t"))))
    return kept.groupBy("inspection_id", "anchor_line").agg(
        F.array_join(F.transform(pieces, lambda p: p["t"]), " ").alias("continuation")
    )


def title_fallback(tokens: DataFrame) -> DataFrame:
    """Largest lettering near the top of the page, merged with its line.

    Near the top: in the upper fifth by height, or in the first fifth of the
    tokens from the top.
    """
    from panelmark.functions.text import bad_generic_name

    extent = tokens.groupBy("inspection_id").agg(
        F.min("y1").alias("_top"), F.max("y2").alias("_bottom"), F.count("*").alias("_n")
    )
    ranked = slices.running_position(
        tokens, ["inspection_id"], [F.col("y1"), F.col("line_no")], "_rank"
    ).join(spread(extent), "inspection_id")
    limit = F.col("_top") + 0.20 * F.greatest(F.lit(1.0), F.col("_bottom") - F.col("_top"))
    top_count = F.greatest(F.lit(1), F.rint(F.col("_n") * 0.20 + 0.5).cast("long"))
    shown = F.trim("text")
    width = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1"))
    upright = (F.col("y2") - F.col("y1")) > 1.8 * width
    size = F.when(upright, F.col("x2") - F.col("x1")).otherwise(F.col("y2") - F.col("y1"))
    # judged where it lies near the top: of the lettering alone the optimizer would judge every line before the join
    shown = F.when((F.col("y1") <= limit) | (F.col("_rank") <= top_count), shown)
    good = (
        shown.isNotNull()
        & ~bad_generic_name(shown)
        & ~has_any(F.upper(shown), C.TITLE_SKIP)
        & ~is_barcode(shown)
        & (F.length(F.regexp_replace(shown, "[^A-Za-z]+", "")) >= 3)
    )
    # read twice below, judged once
    candidates = cut(ranked.where(good).select("inspection_id", "line_no", shown.alias("text"), "confidence", *BOX, size.alias("_size")))
    best = candidates.groupBy("inspection_id").agg(
        F.min_by(
            F.struct(F.col("y1").alias("by"), F.col("_size").alias("bs")),
            F.struct((-F.col("_size")).alias("s"), F.col("line_no")),
        ).alias("_best")
    ).select("inspection_id", "_best.*")
    line = candidates.join(spread(best), "inspection_id").where(
        (F.abs(F.col("y1") - F.col("by")) <= F.greatest(F.lit(15.0), F.col("bs") * 0.45))
        & (F.col("_size") >= F.col("bs") * 0.55)
    )
    pieces = F.array_sort(F.collect_list(F.struct("x1", "line_no", "text")))
    return line.groupBy("inspection_id").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), " ").alias("title"),
        F.avg("confidence").alias("confidence"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )


def translation_memory(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Looks every line up in a dictionary with unique sources.

    The lookup is a left join on the whole line, so a line that is repeated a
    million times costs no translation at all; a miss keeps the line with its
    digits normalised.
    """
    from panelmark.functions.text import indic_digits

    known = dictionary.groupBy("source").agg(F.min("target").alias("_target"))
    joined = tokens.join(spread(known), tokens["text"] == known["source"], "left").drop("source")
    return (
        joined.withColumn("cached", F.col("_target").isNotNull())
        .withColumn("translated", F.coalesce("_target", indic_digits("text")))
        .drop("_target")
    )
