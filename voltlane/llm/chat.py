"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant by turns, the assistant last. Turns may keep
their role, be relabelled, be merged into the message before, or have empty messages put before them; each repair has a
cost, and the cheapest sequence of repairs over a conversation is found by dynamic programming over the four states
(start, after system, after user, after assistant).

The table is sorted once over (conversation, turn), so a long conversation spreads over many sorted partitions. The cost
of each stretch, from each state to each state, is a small matrix; matrices of a conversation are combined and give each
stretch the state it starts and ends in, and the stretches are repaired independently. Texts are not part of this: they
meet their repair by a join and are rendered with SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of repairs; a role that is null or unknown is relabelled cheaply, as it says nothing.
COSTS = {"merge": 1, "relabel": 3, "name": 1, "insert": 4}
#: Empty messages needed before a message of each role, by state; None where none makes it legal.
INSERTS = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Empty messages that end a conversation in each state.
ENDINGS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
FAR = 1 << 40


def steps(role: int, costs: dict[str, int]) -> list[tuple[int, int, int, bool]]:
    """(state, next state, cost, merged) of every way to take a turn; role 0 stands for an unknown one."""
    out = []
    for to in (SYSTEM, USER, ASSISTANT):
        label = 0 if to == role else costs["relabel"] if role else costs["name"]
        for state in range(4):
            if (state, to) in INSERTS:
                out.append((state, to, label + costs["insert"] * len(INSERTS[state, to]), False))
            if state == to:
                out.append((state, to, label + costs["merge"], True))
    return out


class _Repair:
    """Forward costs and backward choices over the turns of one stretch."""

    def __init__(self, costs: dict[str, int]):
        self.moves = []
        for role in range(4):
            best: dict[tuple[int, int], tuple[int, bool]] = {}
            for state, to, cost, merged in steps(role, costs):
                # Of equal costs, a merge is kept: it adds no message.
                if (state, to) not in best or (cost, not merged) < (best[state, to][0], not best[state, to][1]):
                    best[state, to] = (cost, merged)
            self.moves.append(best)
        self.matrix = np.full((4, 4, 4), FAR, dtype=np.int64)
        for role in range(4):
            for (state, to), (cost, _) in self.moves[role].items():
                self.matrix[role, state, to] = cost

    def extend(self, total: np.ndarray, roles: np.ndarray) -> np.ndarray:
        """Costs from every state to every state, after more turns."""
        for r in roles.tolist():
            total = np.minimum((total[:, :, None] + self.matrix[r][None, :, :]).min(axis=1), FAR)
        return total

    def path(self, roles: np.ndarray, start: int, end: int) -> np.ndarray:
        """States after each turn on the cheapest way from ``start`` to ``end``; ties to the lower state."""
        n = len(roles)
        back = np.zeros((n, 4), dtype=np.int8)
        now = np.full(4, FAR, dtype=np.int64)
        now[start] = 0
        for i, r in enumerate(roles.tolist()):
            all_ways = now[:, None] + self.matrix[r]
            back[i] = all_ways.argmin(axis=0)
            now = np.minimum(all_ways.min(axis=0), FAR)
        states = np.empty(n, dtype=np.int8)
        at = end
        for i in range(n - 1, -1, -1):
            states[i] = at
            at = int(back[i, at])
        return states


def _stretches(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal ``columns``, of sorted batches."""
    now, held = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for x, y in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            if held and keys[x] != now:
                yield now, held
                held = []
            now = keys[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield now, held


def _all(parts: list[pa.RecordBatch], column: str) -> np.ndarray:
    return np.concatenate([p.column(column).to_numpy() for p in parts])


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 costs: dict[str, int] | None = None, header: str = "<|{}|>\n", end: str = "<|end|>\n", joint: str = "\n\n") -> DataFrame:
    """One row per turn: conversation, ``piece`` (gapless from 0 in its conversation), turn, role, ``final_role``,
    ``action`` (keep, relabel, merge, relabel+merge), ``inserted`` (roles of empty messages before it), ``ending`` (after the
    last turn), ``rendered``. Concatenated by ``piece``, ``rendered`` is the conversation's text.

    Order is turn (nulls first), then role, text and stored place, so ties and repeated turns have a fixed order. Role
    names are trimmed and lower-cased; null or unknown ones may become any role. Null texts render as empty. Turns without
    conversation id form one conversation. An empty table gives no rows."""
    costs = COSTS | (costs or {})
    named = F.lower(F.btrim(role))
    code = F.coalesce(*[F.when(named == name, F.lit(i + 1)) for i, name in enumerate(ROLES)], F.lit(0))
    rows = turns.select(F.col(conv_id).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("_role"),
                        F.col(text).cast("string").alias("_text"), code.alias("_code"), F.monotonically_increasing_id().alias("_in"))
    ordered = rows.orderBy("_conv", "_turn", "_role", F.xxhash64("_text"), "_in").drop("_in")
    stored = materialize(ordered.withColumn("_mid", F.monotonically_increasing_id()))
    # Null keys never meet in a join; the conversation's key is text with a mark for null.
    key = F.coalesce(F.concat(F.lit("="), F.col("_conv").cast("string")), F.lit("null"))
    keyed = stored.withColumn("_key", key).withColumn("_part", F.shiftright("_mid", 33))
    slim = keyed.select("_key", "_part", "_mid", "_code")

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = _Repair(costs)
        nothing = np.where(np.eye(4, dtype=bool), 0, FAR)
        for (k, part), held in _stretches(batches, ["_key", "_part"]):
            total = nothing
            for h in held:
                total = repair.extend(total, h.column("_code").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k]), pa.array([part], pa.int64()), pa.array([sum(h.num_rows for h in held)], pa.int64()),
                 pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["_key", "_part", "_n", "_costs"])

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ending = np.array([costs["insert"] * len(ENDINGS[s]) for s in range(4)])
        for (k,), held in _stretches(batches, ["_key"]):
            parts, n = _all(held, "_part"), _all(held, "_n")
            matrices = [np.array(c).reshape(4, 4) for h in held for c in h.column("_costs").to_pylist()]
            now, back = np.where(np.arange(4) == START, 0, FAR), []
            for m in matrices:
                ways = now[:, None] + m
                back.append(ways.argmin(axis=0))
                now = np.minimum(ways.min(axis=0), FAR)
            ends = [int((now + ending).argmin())]
            for b in reversed(back):
                ends.append(int(b[ends[-1]]))
            ends.reverse()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(parts)), pa.array(parts), pa.array(np.cumsum(n) - n), pa.array(ends[:-1], pa.int32()),
                 pa.array(ends[1:], pa.int32()), pa.array(np.arange(len(parts)) == len(parts) - 1)],
                names=["_key", "_part", "_before", "_from", "_to", "_last"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = _Repair(costs)
        for (_, _), held in _stretches(batches, ["_key", "_part"]):
            roles, mid = _all(held, "_code"), _all(held, "_mid")
            first = held[0]
            before, start, stop, last = (first.column(c)[0].as_py() for c in ("_before", "_from", "_to", "_last"))
            states = repair.path(roles, start, stop)
            came = np.concatenate([[start], states[:-1]])
            merged = [repair.moves[r][s, t][1] for r, s, t in zip(roles.tolist(), came.tolist(), states.tolist(), strict=True)]
            n = len(roles)
            inserted = [[] if m else [ROLES[x - 1] for x in INSERTS[s, t]]
                        for m, s, t in zip(merged, came.tolist(), states.tolist(), strict=True)]
            # A message ends where the next turn is not merged into it. What the next stretch does with its first turn is
            # not known here: that turn closes the message before it.
            closes = [not m for m in merged[1:]] + [bool(last)]
            opens = [False] * n
            opens[0] = bool(before) and not merged[0]
            ending = [[] for _ in range(n)]
            if last:
                ending[-1] = [ROLES[x - 1] for x in ENDINGS[int(states[-1])]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mid), pa.array(before + np.arange(n), pa.int64()), pa.array([ROLES[s - 1] for s in states.tolist()]),
                 pa.array(merged), pa.array(inserted, pa.list_(pa.string())), pa.array(ending, pa.list_(pa.string())),
                 pa.array(opens), pa.array(closes)],
                names=["_mid", "piece", "final_role", "_merged", "inserted", "ending", "_shut", "_close"])

    costed = (slim.repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_mid")
              .mapInArrow(cost, "_key string, _part bigint, _n bigint, _costs array<bigint>"))
    bound = (costed.repartition("_key").sortWithinPartitions("_key", "_part")
             .mapInArrow(bind, "_key string, _part bigint, _before bigint, _from int, _to int, _last boolean"))
    decided = (slim.join(bound, ["_key", "_part"]).repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_mid")
               .mapInArrow(decide, "_mid bigint, piece bigint, final_role string, _merged boolean, inserted array<string>, "
                                   "ending array<string>, _shut boolean, _close boolean"))

    def empty(roles):
        return F.array_join(F.transform(roles, lambda r: F.concat(F.replace(F.lit(header), F.lit("{}"), r), F.lit(end))), "")

    body = F.concat(F.when(F.col("_shut"), F.lit(end)).otherwise(F.lit("")), empty(F.col("inserted")),
                    F.when(F.col("_merged"), F.lit(joint)).otherwise(F.replace(F.lit(header), F.lit("{}"), F.col("final_role"))),
                    F.coalesce("_text", F.lit("")), F.when(F.col("_close"), F.lit(end)).otherwise(F.lit("")), empty(F.col("ending")))
    relabelled = ~named_equals(F.lower(F.btrim("_role")), F.col("final_role"))
    action = (F.when(relabelled & F.col("_merged"), "relabel+merge").when(F.col("_merged"), "merge")
              .when(relabelled, "relabel").otherwise("keep"))
    return stored.join(decided, "_mid").select(
        F.col("_conv").alias(conv_id), "piece", F.col("_turn").alias(turn), F.col("_role").alias(role), "final_role",
        action.alias("action"), "inserted", "ending", body.alias("rendered"))


def named_equals(a, b):
    return F.coalesce(a == b, F.lit(False))
