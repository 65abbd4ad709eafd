"""Chat formatting: roles of transcript lines by a hidden Markov model, and canonical turns.

Method. A line shows a speaker marker (a word such as ``User:`` or ``[bot]``, or none), a size and whether it
ends in a question. A state is a role and whether the line opens a turn. Transition and emission
probabilities are counted over all labelled training lines. Roles are recovered by Viterbi over the whole
transcript, markers are cut off, and every line is rendered as its part of the canonical text: a line that opens a
turn is preceded by ``<|role|>`` on a line of its own, so a turn ends where the next header stands.

Scale. Lines are range-partitioned by (transcript, order) and written, so a transcript of any length is spread over
pieces. A piece gives, for the transcripts that cross its edges, the best score from each state before it to each state at its
end (max-plus products compose associatively); the pieces of one transcript are chained, which fixes the states at the
edges, and every piece then decodes on its own. The result is that of one Viterbi over the whole. A piece is one
shuffle partition; chaining sees one small matrix per partition.

Defined cases: a null text is an empty line; a null transcript id is a transcript of its own; null order comes first; rows repeated
are lines each; null roles are not learned from; without labelled lines every role is null and nothing is rendered; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from care_analytics.llm.common import text_or_empty, written

# Words that mark a speaker; any other line has no marker.
SPEAKERS = ["user", "human", "you", "question", "q", "customer", "assistant", "ai", "bot", "answer", "a", "agent",
            "system", "context", "instructions"]
MARKER = r"(?i)^\s*(?:[#*\[<|]+\s*)?(" + "|".join(sorted(SPEAKERS, key=len, reverse=True)) + r")\s*(?:[\]>|*]+\s*:?|:)[*]*[ \t]*"
SIZES = [0, 3, 8, 16, 32, 64, 128]         # words; upper ends of the size classes
FEATURES = [("__m", len(SPEAKERS) + 1), ("__s", len(SIZES) + 1), ("__q", 2)]


def observed(text: Column) -> list[Column]:
    """Marker, size and question of a line, as numbers."""
    word = F.lower(F.regexp_extract(text, MARKER, 1))
    words = F.regexp_count(text, F.lit(r"\S+"))
    size = sum(((words > top).cast("int") for top in SIZES), F.lit(0))
    return [F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SPEAKERS]), word), F.lit(0)), F.lit(0)).cast("int").alias("__m"),
            size.cast("int").alias("__s"), F.rtrim(text).endswith("?").cast("int").alias("__q")]

MOST_ROLES = 500           # roles a model is learned for; more are an error

@dataclass
class Hmm:
    """Roles in order; state 2r opens a turn of role r, 2r + 1 goes on with it. All in log space."""

    roles: list[str]
    start: np.ndarray                       # (states,)
    step: np.ndarray                        # (from, to)
    emit: list[np.ndarray]                  # per feature (states, values)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum(e[:, features[:, k]].T for k, e in enumerate(self.emit))

    def forward(self, score: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over chains that lie one after another in ``score``, all in step, longest first. ``first`` (chains, states)
        is the score of each state before its first line is seen. Returns the last scores of each chain, the best
        predecessor of each state of each line, and the place of each line in the order of work."""
        order = np.argsort(-lengths, kind="stable")
        start = (np.cumsum(lengths) - lengths)[order]
        open_at = np.searchsorted(-lengths[order], -np.arange(int(lengths.max())), side="left")
        last = np.empty((len(lengths), score.shape[1]))
        back = np.zeros(score.shape, np.int8 if score.shape[1] <= 128 else np.int16)
        now = first[order] + score[start]
        for t in range(1, len(open_at)):
            n = int(open_at[t])
            last[order[n:len(now)]] = now[n:]
            paths = now[:n, :, None] + self.step[None]
            best = paths.argmax(axis=1)
            back[start[:n] + t] = best
            now = np.take_along_axis(paths, best[:, None, :], axis=1)[:, 0] + score[start[:n] + t]
        last[order[:len(now)]] = now
        return last, back, order

    def paths(self, score: np.ndarray, lengths: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
        """Best states of chains; ``entry`` is the state before a chain and ``leave`` its last state, -1 where open."""
        first = np.where((entry >= 0)[:, None], self.step[np.maximum(entry, 0)], self.start[None])
        last, back, order = self.forward(score, lengths, first)
        state = np.where(leave >= 0, leave, last.argmax(axis=1))
        out = np.empty(len(score), np.int64)
        ends = np.cumsum(lengths)
        chains = order
        now = state[chains]
        place = ends[chains] - 1
        left = lengths[chains].copy()
        while len(chains):
            out[place] = now
            now = back[place, now]
            left -= 1
            place = place - 1
            keep = left > 0
            chains, now, place, left = chains[keep], now[keep].astype(np.int64), place[keep], left[keep]
        return out

    def matrix(self, score: np.ndarray) -> np.ndarray:
        """(states + 1, states): best score from each state before a chain (the last row: from the start) to each state at its end."""
        k = len(self.start)
        first = np.vstack([self.step, self.start[None]])
        last, _, _ = self.forward(np.tile(score, (k + 1, 1)), np.full(k + 1, len(score)), first)
        return last


def arranged(lines: DataFrame, id_col: str, order_cols: list[str], text_col: str) -> DataFrame:
    """``lines`` in order with ``__at`` (unique, increasing), ``__piece`` (its partition) and what each line shows, written."""
    rows = lines.withColumns({"__m": observed(text_or_empty(text_col))[0], "__s": observed(text_or_empty(text_col))[1],
                              "__q": observed(text_or_empty(text_col))[2]}) \
        .repartitionByRange(id_col, *order_cols).sortWithinPartitions(id_col, *order_cols)
    return written(rows.withColumns({"__at": F.monotonically_increasing_id(), "__piece": F.spark_partition_id()}), "chat-lines")


def _chains(table: pa.Table, id_name: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a piece in order, the first row of each transcript, and its number of rows."""
    table = table.take(pc.sort_indices(table, sort_keys=[("__at", "ascending")]))
    code = pc.fill_null(table.column(id_name).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return table, first, np.diff(np.r_[first, len(code)])


def _features(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(name).to_numpy() for name, _ in FEATURES], axis=1)


def train(rows: DataFrame, id_col: str, role_col: str, opens_col: str, learn_col: str) -> Hmm | None:
    """A model counted over the lines of ``arranged`` rows with ``learn_col`` true and a role; None if there is none."""
    roles = [r[0] for r in rows.filter(F.col(learn_col) & F.col(role_col).isNotNull()).select(role_col).distinct().orderBy(role_col).limit(MOST_ROLES + 1).collect()]
    if len(roles) > MOST_ROLES:
        raise ValueError(f"more than {MOST_ROLES} roles: the model has two states for each and a weight for each pair of states")
    if not roles:
        return None
    k = 2 * len(roles)
    sizes = [k, k * k] + [k * n for _, n in FEATURES]

    def count(table: pa.Table) -> pa.Table:
        table, first, _ = _chains(table, "__id")
        role = np.array([roles.index(r) if r in roles else -1 for r in table.column("__role").to_pylist()], np.int64)
        state = np.where(role >= 0, 2 * role + ~table.column("__opens").to_numpy(), -1)
        use = (state >= 0) & table.column("__learn").to_numpy()
        starts = np.zeros(len(state), np.bool_)
        starts[first] = True
        pair = np.flatnonzero(use[1:] & use[:-1] & ~starts[1:])
        parts = [np.bincount(state[starts & use], minlength=k), np.bincount(state[pair] * k + state[pair + 1], minlength=k * k)]
        features = _features(table)
        parts += [np.bincount(state[use] * n + features[use, f], minlength=k * n) for f, (_, n) in enumerate(FEATURES)]
        flat = np.concatenate(parts)
        at = np.flatnonzero(flat)
        return pa.table({"cell": pa.array(at, pa.int32()), "n": pa.array(flat[at], pa.int64())})

    labelled = rows.select("__piece", F.col(id_col).alias("__id"), "__at", *[name for name, _ in FEATURES],
                           F.col(role_col).alias("__role"), F.col(opens_col).alias("__opens"),
                           F.coalesce(F.col(learn_col), F.lit(False)).alias("__learn"))
    flat = np.full(sum(sizes), 0.5)
    for r in labelled.groupBy("__piece").applyInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        flat[r["cell"]] += r["n"]                              # one number per probability of the model
    start, step, *emit = np.split(flat, np.cumsum(sizes)[:-1])
    share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Hmm(roles, share(start), share(step.reshape(k, k)), [share(e.reshape(k, n)) for e, (_, n) in zip(emit, FEATURES)])


def decode(rows: DataFrame, model: Hmm, id_col: str) -> DataFrame:
    """(__line, __state) for each of ``arranged`` rows."""
    narrow = rows.select("__piece", F.col(id_col).alias("__id"), "__at", *[name for name, _ in FEATURES])
    k = len(model.start)
    kind = rows.schema[id_col].dataType

    def edges(table: pa.Table) -> pa.Table:
        table, first, size = _chains(table, "__id")
        ends = sorted({0, len(first) - 1})
        flat = [model.matrix(model.scores(_features(table.slice(int(first[c]), int(size[c]))))).reshape(-1).tolist() for c in ends]
        return pa.table({"__id": table.column("__id").take(pa.array(first[ends])), "__piece": table.column("__piece").take(pa.array(first[ends])),
                         "__matrix": pa.array(flat, pa.list_(pa.float64()))})

    schema = T.StructType([T.StructField("__id", kind), T.StructField("__piece", T.IntegerType()), T.StructField("__matrix", T.ArrayType(T.DoubleType()))])
    matrices = written(narrow.groupBy("__piece").applyInArrow(edges, schema), "chat-edges")

    def chain(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("__piece", "ascending")]))
        steps = [np.array(m).reshape(k + 1, k) for m in table.column("__matrix").to_pylist()]
        now, back = steps[0][k], []
        for m in steps[1:]:
            paths = now[:, None] + m[:k]
            back.append(paths.argmax(axis=0))
            now = paths.max(axis=0)
        leave = [int(now.argmax())]
        for b in reversed(back):
            leave.append(int(b[leave[-1]]))
        leave.reverse()
        return pa.table({"__piece": table.column("__piece"), "__eid": table.column("__id"),
                         "__entry": pa.array([-1, *leave[:-1]], pa.int32()), "__leave": pa.array(leave, pa.int32())})

    schema = T.StructType([T.StructField("__piece", T.IntegerType()), T.StructField("__eid", kind),
                           T.StructField("__entry", T.IntegerType()), T.StructField("__leave", T.IntegerType())])
    bounds = written(matrices.groupBy("__id").applyInArrow(chain, schema), "chat-bounds")

    def states(table: pa.Table, bound: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"__line": pa.array([], pa.int64()), "__state": pa.array([], pa.int32())})
        table, first, size = _chains(table, "__id")
        entry, leave = np.full(len(first), -1), np.full(len(first), -1)
        ends = {table.column("__id")[int(first[c])].as_py(): c for c in (0, len(first) - 1)}
        for i, e, x in zip(bound.column("__eid").to_pylist(), bound.column("__entry").to_pylist(), bound.column("__leave").to_pylist()):
            entry[ends[i]], leave[ends[i]] = e, x
        path = model.paths(model.scores(_features(table)), size, entry, leave)
        return pa.table({"__line": table.column("__at"), "__state": pa.array(path.astype(np.int32))})

    return narrow.groupBy("__piece").cogroup(bounds.groupBy("__piece")).applyInArrow(states, "__line long, __state int")


def format_chat(lines: DataFrame, id_col: str, order_cols: list[str], text_col: str, role_col: str, opens_col: str,
                learn_col: str) -> DataFrame:
    """The rows of ``lines`` with ``role_pred``, ``opens_pred``, ``content`` (its marker cut off where it opens a turn) and
    ``rendered``, its part of the canonical text. Learned from lines with ``learn_col`` true and a role."""
    rows = arranged(lines, id_col, order_cols, text_col)
    model = train(rows, id_col, role_col, opens_col, learn_col)
    own = [F.col(c) for c in lines.columns]
    text = text_or_empty(text_col)
    if model is None:
        return rows.select(*own, F.lit(None).cast("string").alias("role_pred"), F.lit(None).cast("boolean").alias("opens_pred"),
                           text.alias("content"), F.lit(None).cast("string").alias("rendered"))
    found = written(decode(rows, model, id_col), "chat-states")
    roles = F.array(*[F.lit(r) for r in model.roles])
    opens = F.col("__state") % 2 == 0
    return rows.join(found, F.col("__at") == F.col("__line")) \
        .select(*own, F.element_at(roles, F.floor(F.col("__state") / 2).cast("int") + 1).alias("role_pred"), opens.alias("opens_pred"),
                F.when(opens, F.regexp_replace(text, MARKER, "")).otherwise(text).alias("content")) \
        .withColumn("rendered", F.when(F.col("opens_pred"), F.concat(F.lit("<|"), "role_pred", F.lit("|>\n"), "content")).otherwise(F.col("content")))


def transcribe(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """Plain transcripts of labelled turns: (id, turn, line, opens, role, text). A transcript has one of five styles of
    markers, by its id, and one turn in five has none. Repeated turns are one."""
    styles = [("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "Context: "), ("Q: ", "A: ", "Instructions: "),
              ("[user] ", "[assistant] ", "[system] "), ("**You:** ", "**Bot:** ", "**System:** ")]
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"),
                        text_or_empty(text_col).alias("said")).distinct()
    style = F.pmod(F.xxhash64("conv"), F.lit(len(styles)))
    marker = F.lit("")
    for k, names in enumerate(styles):
        for role, name in zip(("user", "assistant", "system"), names):
            marker = F.when((style == k) & (F.col("role") == role), name).otherwise(marker)
    marker = F.when(F.pmod(F.xxhash64("conv", "turn"), F.lit(5)) == 0, "").otherwise(marker)
    return rows.withColumn("place", F.xxhash64("role", "said")).withColumn("marker", marker) \
        .select("conv", "turn", "place", "role", "marker", F.posexplode(F.split("said", "\n")).alias("line", "part")) \
        .select("conv", "turn", "place", "line", "role", (F.col("line") == 0).alias("opens"),
                F.when(F.col("line") == 0, F.concat("marker", "part")).otherwise(F.col("part")).alias("text"))
