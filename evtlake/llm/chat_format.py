"""Chat formatting with minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant in turn, ending with
an assistant. A turn of the input may keep its role (no cost), take another role (relabel),
join the turn before it (merge), and missing turns may be put in empty (insert). The cheapest
repair is a shortest path: states are the role of the last turn written, each input turn is a
small matrix of costs between states, and costs of stretches multiply in the (min, +) sense.
So a conversation is cut into blocks of turns, blocks are multiplied apart from each other,
only block matrices are chained, and each block is then solved between its two states. Where
there are many blocks, their matrices are multiplied in groups and so on upwards, so that no
task ever holds more than one group of a conversation. The result is one row per written
piece; pieces in order, put together, are the formatted chat.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evtlake.llm.common import stored
from evtlake.llm.jaccard_join import sorted_groups
from evtlake.plans.ordering import number_rows

ROLES = ("system", "user", "assistant")
#: States: nothing written yet, or the role of the last written turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs. A merge of turns said to have one role is cheaper than any insertion; relabelling an unknown role is cheap.
MERGE, MERGE_OTHER, INSERT, RELABEL, NAME_UNKNOWN, SYSTEM_LATE = 1, 4, 2, 3, 2, 3
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
BLOCK_TURNS = 2048
#: Block matrices of a conversation that one task chains; above that, groups of them are multiplied first.
CHAINED = 1024
NEVER = 1 << 40
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _legal_next(state: int) -> tuple[int, ...]:
    return {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}[state]


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest lists of empty turns that make ``role`` legal after ``state``."""
    out = {}
    for state in range(4):
        for role in (SYSTEM, USER, ASSISTANT):
            for path in ((), (USER,), (ASSISTANT,), (USER, ASSISTANT), (ASSISTANT, USER)):
                here, legal = state, True
                for step in (*path, role):
                    legal &= step in _legal_next(here)
                    here = step
                if legal:
                    out.setdefault((state, role), path)
                    break
    return out


INSERTS = _inserts()


def turn_options(said: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """(state, state after) -> (cost, action, empty turns before) of one turn; said: state of its role, 0 if unknown."""
    options: dict[tuple[int, int], tuple[int, str, tuple[int, ...]]] = {}

    def offer(a: int, b: int, cost: int, action: str, before: tuple[int, ...] = ()) -> None:
        if cost < options.get((a, b), (NEVER,))[0]:
            options[a, b] = (cost, action, before)

    for state in range(4):
        for role in (SYSTEM, USER, ASSISTANT):
            if (state, role) in INSERTS:
                before = INSERTS[state, role]
                change = 0 if role == said else NAME_UNKNOWN if said == START else RELABEL
                offer(state, role, change + INSERT * len(before), "keep" if not change else "relabel", before)
        if state:
            offer(state, state, MERGE if state == said else MERGE_OTHER, "merge")
    return options


OPTIONS = [turn_options(said) for said in range(4)]
COSTS = np.full((4, 4, 4), NEVER, np.int64)
for _said, _options in enumerate(OPTIONS):
    for (_a, _b), (_cost, *_) in _options.items():
        COSTS[_said, _a, _b] = _cost
#: Cost of ending in each state: an assistant turn may have to be put in.
FINAL = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """(min, +) product."""
    out = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)
    for m in matrices:
        out = np.minimum((out[:, :, None] + m[None, :, :]).min(axis=1), NEVER)
    return out


def cheapest(said: list[int], entry: int, leave: int) -> list[int]:
    """States after each turn on the cheapest path from ``entry`` to ``leave``; of equal costs the lower state, from the end."""
    costs = np.full((len(said) + 1, 4), NEVER, np.int64)
    costs[0, entry] = 0
    for i, s in enumerate(said):
        costs[i + 1] = np.minimum((costs[i][:, None] + COSTS[s]).min(axis=0), NEVER)
    states, here = [leave], leave
    for i in range(len(said) - 1, 0, -1):
        here = int(np.argmin(costs[i] + COSTS[said[i]][:, here]))
        states.append(here)
    return states[::-1] if said else []


def chain(matrices: list[np.ndarray], entry: int, leave: int | None) -> list[int]:
    """States at the ends of blocks on the cheapest path from ``entry`` to ``leave``, or to where ending is cheapest."""
    costs = [np.where(np.arange(4) == entry, 0, NEVER)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), NEVER))
    here = int(np.argmin(costs[-1] + FINAL)) if leave is None else leave
    states = [here]
    for i in range(len(matrices) - 1, 0, -1):
        here = int(np.argmin(costs[i] + matrices[i][:, here]))
        states.append(here)
    return states[::-1]


def ends_of_blocks(matrices: DataFrame, conv: str, chained: int) -> DataFrame:
    """conv_id, block, entry, leave and last: the states between which each block of ``matrices`` (conv_id, block, m) is solved.

    Groups of ``chained`` blocks are blocks of the level above, where there is more than one
    group; that level fixes the states at the ends of each group.
    """
    groups = matrices.groupBy("conv_id", F.expr(f"block div {chained}").alias("upper")).agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("b"))
    groups = stored(groups, "chat-groups")
    kinds = f"conv_id {conv}, block bigint, entry int, leave int, last boolean"
    read = lambda b: [np.array(x["m"], np.int64).reshape(4, 4) for x in b]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [product(read(b)).ravel().tolist() for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m, pa.list_(pa.int64()))], ["conv_id", "block", "m"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, which, entry, leave, last = [], [], [], [], []
            for i, (b, start, end, ending) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, 5)))):
                states = chain(read(b), start, end)
                ids += [i] * len(b)
                which += [x["block"] for x in b]
                entry += [start, *states[:-1]]
                leave += states
                last += [False] * (len(b) - 1) + [ending]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(which, pa.int64()), pa.array(entry, pa.int32()), pa.array(leave, pa.int32()), pa.array(last, pa.bool_())],
                ["conv_id", "block", "entry", "leave", "last"])

    if groups.where("upper > 0").isEmpty():
        bound = groups.select("conv_id", "b", F.lit(START).alias("entry"), F.lit(None).cast("int").alias("leave"), F.lit(True).alias("last"))
    else:
        above = ends_of_blocks(groups.mapInArrow(multiply, f"conv_id {conv}, block bigint, m array<bigint>"), conv, chained)
        above = above.withColumnsRenamed({"conv_id": "_c", "block": "_b"})
        bound = groups.join(above, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("upper") == F.col("_b"))).select("conv_id", "b", "entry", "leave", "last")
    return bound.mapInArrow(follow, kinds)


def _said(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 block_turns: int = BLOCK_TURNS, chained: int = CHAINED) -> DataFrame:
    """conv_id, pos, turn, said, role, action, n_inserted, rendered and cost, one row per row of ``turns``.

    ``rendered`` is the piece of the formatted chat that the turn adds: empty turns put in before
    it, its opening mark unless it is merged, its text, and what closes the conversation. Turns
    stand in the order of turn, role and text (NULL first); equal rows follow each other. NULL
    texts are empty, NULL and unknown roles are named; turns without conv_id are one conversation.
    ``cost`` is the turn's share of the repair. No rows give no rows; other columns are ignored.
    """
    conv = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("said"), F.col(text_col).alias("text"))
    order = rows.withColumns({"_none": F.col("conv_id").isNull(), "_order": F.xxhash64("text")})
    numbered = number_rows(order, ["conv_id"], ["turn", "said", "_order"], "pos").withColumn("block", F.expr(f"pos div {block_turns}"))
    numbered = stored(numbered.drop("_none", "_order"), "chat-turns")
    names = F.coalesce(F.lower(F.trim("said")), F.lit(""))
    state = F.lit(0)
    for name, target in [*((r, r) for r in ROLES), *ALIASES.items()]:
        state = F.when(names == name, ROLES.index(target) + 1).otherwise(state)
    roles = numbered.select("conv_id", "block", F.struct("pos", state.cast("int").alias("s")).alias("t")).groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", "block", F.col("t.s").alias("s"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [product([COSTS[x] for x in s]).ravel().tolist() for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m, pa.list_(pa.int64()))], ["conv_id", "block", "m"])

    blocks = stored(roles, "chat-blocks")
    matrices = blocks.mapInArrow(multiply, f"conv_id {conv}, block bigint, m array<bigint>")
    bounds = ends_of_blocks(matrices, conv, chained)
    both = blocks.join(bounds.withColumnsRenamed({"conv_id": "_c", "block": "_b"}), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, states, actions, costs, before, closing = [], [], [], [], [], [], []
            for i, (block, said, entry, leave, last) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, 6)))):
                here = entry
                path = cheapest(said, entry, leave)
                for j, (s, to) in enumerate(zip(said, path)):
                    cost, action, empty = OPTIONS[s][here, to]
                    ids.append(i), pos.append(block * block_turns + j), states.append(ROLES[to - 1]), actions.append(action)
                    before.append([ROLES[r - 1] for r in empty])
                    end = CLOSING[to] if last and j == len(said) - 1 else ()
                    closing.append([ROLES[r - 1] for r in end] if last and j == len(said) - 1 else None)
                    costs.append(cost + INSERT * len(end))
                    here = to
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(pos, pa.int64()), pa.array(states, pa.string()), pa.array(actions, pa.string()),
                 pa.array(costs, pa.int64()), pa.array(before, text), pa.array(closing, text)],
                ["conv_id", "pos", "role", "action", "cost", "before", "closing"])

    repairs = both.select("conv_id", "block", "s", "entry", "leave", "last").mapInArrow(
        solve, f"conv_id {conv}, pos bigint, role string, action string, cost bigint, before array<string>, closing array<string>")
    repairs = repairs.withColumnsRenamed({"conv_id": "_c", "pos": "_p"})
    out = numbered.join(repairs, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_p")))
    mark = lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n"))
    empty = lambda c: F.array_join(F.transform(c, lambda r: F.concat(mark(r), F.lit(CLOSE))), "")
    opening = F.when(F.col("action") == "merge", F.lit("\n")).otherwise(F.concat(F.when(F.col("pos") > 0, F.lit("\n" + CLOSE)).otherwise(""), empty("before"), mark(F.col("role"))))
    ending = F.when(F.col("closing").isNull(), "").otherwise(F.concat(F.lit("\n" + CLOSE), F.coalesce(empty("closing"), F.lit(""))))
    return out.select("conv_id", "pos", "turn", "said", "role", "action", (F.size("before") + F.coalesce(F.size("closing"), F.lit(0))).alias("n_inserted"),
                      F.concat(opening, F.coalesce("text", F.lit("")), ending).alias("rendered"), "cost")
