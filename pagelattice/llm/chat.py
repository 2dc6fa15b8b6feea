r"""Chat formatting in budgeted windows, with built-in functions only.

A turn is written ``<turn role>`` newline, text, ``</turn>`` newline. In texts and roles ``&`` becomes
``&amp;`` and ``<`` becomes ``&lt;``, so no text can hold a control string, and the change can be
undone. The loss mask of a window is a list of code point ranges over its formatted text.

Windows: a turn's tokens are counted by a pattern, prefix sums of them lay the turns of a conversation
on a line, and the line is cut at multiples of the room for targets. The turns that lie whole between
two cuts form a window; a turn across a cut has a window of its own. Each window begins with the
conversation's system turn, then repeats as many earlier turns as fit the history budget; both
are masked where they are repeats. So every turn is a target exactly once and no turn is cut. The targets of a
window keep within the budget less ``HISTORY`` and ``SYSTEM`` unless a single turn is over that. A window passes the budget
where such a turn comes with history, or where the system turn is over ``SYSTEM``: neither is shortened.

Prefix sums run over blocks of turns by turn number first, then within the blocks, so a conversation of any
length is spread over tasks as far as its turn numbers differ. Turns are ordered by ``turn``, then role, then text; nulls come first. A null text
or role is empty. Repeated rows are turns of their own. A null conversation id is a conversation. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUDGET = 2048
HISTORY = 512
SYSTEM = 256
#: Turns that one block of the prefix sums holds, by turn number.
BLOCK = 1000


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def token_count(text: Column) -> Column:
    """Words and other signs: a stand-in for a tokenizer that is a built-in function."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{1,6}|[^\s\p{L}\p{N}]")).cast("bigint")


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows numbered within their conversation (``n``), with written form and prefix sum of tokens."""
    own = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    body = escape(F.col("text"))
    own = own.withColumn("tokens", token_count(F.col("text")) + 3).withColumn(
        "written", F.concat(F.lit("<turn "), F.replace(escape(F.col("role")), F.lit(">"), F.lit("&gt;")), F.lit(">\n"), body, F.lit("</turn>\n"))
    ).withColumn("body_length", F.char_length(body).cast("bigint")).withColumn("block", F.expr(f"coalesce(floor(turn / {BLOCK}), -1)"))
    sums = own.groupBy("conv", "block").agg(F.sum("tokens").alias("block_tokens"), F.count("*").alias("block_rows"))
    before = "over (partition by conv order by block rows between unbounded preceding and 1 preceding)"
    sums = sums.select(
        F.col("conv").alias("b_conv"), F.col("block").alias("b_block"),
        F.expr(f"coalesce(sum(block_tokens) {before}, 0)").alias("tokens_before"),
        F.expr(f"coalesce(sum(block_rows) {before}, 0)").alias("rows_before"),
    )
    within = "over (partition by conv, block order by turn, role, text rows between unbounded preceding and current row)"
    ranked = own.withColumn("k", F.expr(f"count(*) {within}")).withColumn("upto", F.expr(f"sum(tokens) {within}"))
    joined = ranked.join(sums, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    return joined.select(
        "conv", "role", "text", "tokens", "written", "body_length",
        (F.col("rows_before") + F.col("k") - 1).alias("n"),
        (F.col("tokens_before") + F.col("upto") - F.col("tokens")).alias("low"),
        (F.col("tokens_before") + F.col("upto")).alias("high"),
    )


def windows(numbered: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM) -> DataFrame:
    """(``conv``, ``window``, ``first``, ``last``, ``formatted``, ``loss``): one row per window.

    ``first`` and ``last`` number the turns that the window adds; ``loss`` is an array of
    (``start``, ``length``, ``n``) in code points of ``formatted``. ``n`` is the turn's number.
    """
    room = budget - history - system
    low_cell, high_cell = F.expr(f"low div {room}"), F.expr(f"(high - 1) div {room}")
    cell = F.when(low_cell == high_cell, 2 * low_cell).otherwise(2 * low_cell + 1)
    # A turn over several cells still has a cell number of its own: no other turn ends in it.
    placed = numbered.withColumn("cell", cell)
    # History: earlier turns whose tokens lie within the budget before the window's first token.
    # A turn may serve the windows that start within that distance after it.
    heads = placed.groupBy("conv", "cell").agg(F.min("low").alias("head"), F.min("n").alias("first"), F.max("n").alias("last"))
    reach = F.expr(f"sequence(high div {history}, (high + {history}) div {history})")
    donors = placed.where(F.col("tokens") <= history).select("conv", "n", "low", "high", "role", "written", "body_length", F.explode(reach).alias("slab"))
    aims = heads.select(
        F.col("conv").alias("h_conv"), F.col("cell").alias("h_cell"), "head", "first", F.expr(f"head div {history}").alias("h_slab")
    )
    repeats = donors.join(aims, F.col("conv").eqNullSafe(F.col("h_conv")) & (F.col("slab") == F.col("h_slab"))).where(
        (F.col("high") <= F.col("head")) & (F.col("low") >= F.col("head") - history) & (F.col("n") > 0)
    )
    part = lambda kind, loss: F.struct(
        F.lit(kind).alias("kind"), F.col("n"), F.col("role"), F.col("written"), F.col("body_length"), loss.alias("train")
    )
    targets = placed.select("conv", "cell", part(2, F.col("role") == "assistant").alias("part"))
    kept = repeats.select("conv", F.col("h_cell").alias("cell"), part(1, F.lit(False)).alias("part"))
    opening = placed.where("n = 0 and (role = 'system')").select(
        F.col("conv").alias("s_conv"), "n", "role", "written", "body_length"
    )
    systems = heads.where("first > 0").select("conv", "cell").join(opening, F.col("conv").eqNullSafe(F.col("s_conv"))).select(
        "conv", "cell", part(0, F.lit(False)).alias("part")
    )
    # The first turn, if it is not the system turn, may be history as any other.
    start = donors.where("n = 0 and role <> 'system'").join(aims, F.col("conv").eqNullSafe(F.col("h_conv")) & (F.col("slab") == F.col("h_slab"))).where(
        (F.col("high") <= F.col("head")) & (F.col("low") >= F.col("head") - history)
    ).select("conv", F.col("h_cell").alias("cell"), part(1, F.lit(False)).alias("part"))
    gathered = targets.unionAll(kept).unionAll(start).unionAll(systems).groupBy("conv", "cell").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    loss = F.expr(
        "aggregate(parts, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint,n:bigint>>)), (a, p) -> "
        "named_struct('at', a.at + char_length(p.written), 'spans', if(p.train, concat(a.spans, array(named_struct("
        "'start', a.at + char_length(p.written) - 8 - p.body_length, 'length', p.body_length, 'n', p.n))), a.spans))).spans"
    )
    targeted = F.filter("parts", lambda p: p["kind"] == 2)
    return gathered.select(
        "conv", F.col("cell").alias("window"),
        F.array_min(F.transform(targeted, lambda p: p["n"])).alias("first"),
        F.array_max(F.transform(targeted, lambda p: p["n"])).alias("last"),
        F.array_join(F.transform("parts", lambda p: p["written"]), "").alias("formatted"),
        loss.alias("loss"),
    )


def turns_of_window() -> Column:
    """Array of (``n``, ``role``, ``text``): the turns a window adds, parsed from its formatted text.

    They are its last turns, numbered ``first`` to ``last``.
    """
    count = F.col("last") - F.col("first") + 1
    pieces = F.expr("split(formatted, '</turn>\\n', -1)")
    own = F.slice(pieces, (F.size(pieces) - count).cast("int"), count.cast("int"))

    def parsed(piece, i):
        head = F.locate(">\n", piece)
        role = F.substr(piece, F.lit(7), head - 7)
        return F.struct(
            (F.col("first") + i).alias("n"),
            unescape(F.replace(role, F.lit("&gt;"), F.lit(">"))).alias("role"),
            unescape(F.substr(piece, head + 2)).alias("text"),
        )

    return F.transform(own, parsed)


def loss_of_window() -> Column:
    """Array of (``n``, ``text``): the texts under a window's loss mask, unescaped."""
    span = lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
    return F.transform("loss", lambda s: F.struct(s["n"].alias("n"), unescape(span(s)).alias("text")))
