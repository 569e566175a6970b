"""Packing of token pieces into sequences by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence. The program (fewest sequences whose
configurations cover the histogram) has one row for each length, at most `capacity` of them, however many
documents there are. Multiplicative weights solve it: each length has a price, which falls as it is covered;
a knapsack dynamic program finds the configuration of the highest price. What the mixture of configurations leaves open is
solved again by itself, so that no length is covered more than it must be. Rounding uses whole parts of the solution,
then whole parts of the program of what is left; pieces that remain go by the prices of the programs: the dearest
configuration of the rest is used as often as the rest allows, and the last FEW pieces go by best fit. The result is a
list of configurations with multiplicities; the pieces of a length take places in it by their rank, in parallel.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.shared import arrow, cut, with_texts
from notewright.llm.tokens import encoded, tokenizer_path

GAP = 0.005  #: of the program: its cover is within that share of the bound, as a rule; Program.gap says what it is
ROUNDS, LEAST_ROUNDS = 2, 1000  #: of weights in a phase, for each length or in all
PHASES, LITTLE = 3, 0.05  #: of the program at most; share of the tokens that is left to the last step
STEP, FRESH = 0.05, 20  #: how fast prices fall; rounds between two looks at all configurations
SOLVES, FEW = 2, 300  #: programs that are solved at most; pieces that best fit takes at the end
CONVEX = 1.15  #: first prices are lengths to this power: among full configurations those with long pieces come first
Configuration = tuple[tuple[int, int], ...]  #: (length, how often), longest first


@dataclass
class Program:
    """A solution: how often each configuration is used, the mean price of each length (in order), least and own number of sequences."""

    cover: dict[Configuration, float]
    price: np.ndarray
    bound: float
    sequences: float

    @property
    def gap(self) -> float:
        """How far the cover is from the bound: a share of it."""
        return self.sequences / self.bound - 1


def best_configuration(lengths: np.ndarray, price: np.ndarray, capacity: int) -> dict[int, int]:
    """The knapsack of the highest total price: lengths may repeat."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], 0
        if n := upto[c]:
            value = best[c - lengths[:n]] + price[:n]
            i = int(value.argmax())
            if value[i] > best[c]:
                best[c], last[c] = value[i], lengths[i]
    config: dict[int, int] = {}
    c = capacity
    while c > 0:
        if length := int(last[c]):
            config[length] = config.get(length, 0) + 1
            c -= length
        else:
            c -= 1
    return config


def _weigh(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, gap: float):
    """Multiplicative weights: (configurations, how often each was used, mean price, prices by the last weights, least number of sequences).

    Prices of all pieces add up to 1, so no cover has fewer sequences than 1 / (price of the best configuration). A
    configuration is used as often as covers one of its lengths once over, and the weights of its lengths fall.
    Configurations found before are used again while their price is within STEP of the best one found by the
    knapsack; the program over all configurations is looked at every FRESH rounds and when there is none."""
    weight, covered = (lengths / capacity) ** CONVEX * demand, np.zeros(len(lengths))
    pool, keys, used = np.zeros((64, len(lengths))), [], np.zeros(64)
    number: dict[Configuration, int] = {}
    bound, best, mean = float(lengths @ demand) / capacity, 0.0, np.zeros(len(lengths))  # the first bound: lengths as prices
    for t in range(1, rounds + 1):
        price = weight / weight.sum() / demand
        mean += price
        scores = pool[: len(keys)] @ price
        at = int(scores.argmax()) if len(keys) else -1
        if at < 0 or t % FRESH == 0 or scores[at] < (1 - STEP) * best:
            config = best_configuration(lengths, price, capacity)
            key = tuple(sorted(config.items(), reverse=True))
            if key not in number:
                number[key] = len(keys)
                keys.append(key)
                if len(keys) > len(pool):
                    pool, used = np.concatenate([pool, np.zeros_like(pool)]), np.concatenate([used, np.zeros_like(used)])
                pool[len(keys) - 1, np.searchsorted(lengths, list(config))] = list(config.values())
            at = number[key]
            best = float(pool[at] @ price)
            bound = max(bound, 1 / best)
        row = pool[at]
        has = row > 0
        amount = (demand[has] / row[has]).min()
        used[at] += amount
        share = amount * row / demand
        covered += share
        weight *= np.exp(-STEP * share)
        if t % FRESH == 0 and (least := covered.min()) > 0 and used.sum() / least <= (1 + gap) * bound:
            break
    return pool[: len(keys)], used[: len(keys)], mean / t, bound


def solve_program(counts: dict[int, int], capacity: int, gap: float = GAP) -> Program:
    """A fractional cover of the histogram by configurations, and the least number of sequences any cover has.

    Multiplicative weights give a mixture of configurations, in which some lengths are covered too often. So each
    configuration is taken as far as no length is, and what is left open is weighed anew, by itself, with fresh weights. When
    little is open, or PHASES have passed, the configurations of the highest price cover it. The cover is within `gap` of the
    bound, or Program.gap says how far it got."""
    every = np.array(sorted(counts))
    demand = np.array([counts[x] for x in every.tolist()], float)
    left, cover, bound, price = demand.copy(), {}, 0.0, np.zeros(len(every))

    def take(row: np.ndarray, lengths: np.ndarray, amount: float) -> None:
        key = tuple((int(k), int(n)) for k, n in zip(lengths[::-1], row[::-1]) if n)
        cover[key] = cover.get(key, 0.0) + amount
        left[np.searchsorted(every, lengths)] -= amount * row

    for phase in range(PHASES):
        open_ = left > 1e-9 * demand
        if open_.sum() < 2 or every[open_] @ left[open_] <= LITTLE * (every @ demand):
            break
        lengths = every[open_]
        pool, used, mean, least = _weigh(lengths, left[open_], capacity, max(LEAST_ROUNDS, ROUNDS * len(lengths)), gap)
        if not phase:
            bound = least
        price[open_] = mean * (lengths @ left[open_])  # by its own scale: a price a token is about 1
        used = used * float(lengths @ left[open_]) / float(used @ (pool @ lengths))
        for i in np.argsort(-used, kind="stable"):
            has = pool[i] > 0
            amount = min(used[i], float((left[open_][has] / pool[i][has]).min()))
            if amount > 1e-9:
                take(pool[i], lengths, amount)
    bound = bound or float(every @ demand) / capacity
    tilt = np.maximum(price, 1e-9) * (every / capacity) ** (CONVEX - 1)
    while (open_ := left > 1e-9 * demand).any():
        lengths = every[open_]
        row = np.zeros(len(lengths))
        config = best_configuration(lengths, tilt[open_], capacity)
        row[np.searchsorted(lengths, list(config))] = list(config.values())
        has = row > 0
        take(row, lengths, float((left[open_][has] / row[has]).min()))
    return Program(cover, price, bound, sum(cover.values()))


def best_fit(rest: dict[int, int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; sequences of equal free space are one stack."""
    by_space: dict[int, list[list[int]]] = {}
    out = []
    for length in sorted(rest, reverse=True):
        for _ in range(rest[length]):
            space = min((s for s in by_space if s >= length), default=None)
            if space is None:
                sequence, space = [], capacity
                out.append(sequence)
            else:
                sequence = by_space[space].pop()
                if not by_space[space]:
                    del by_space[space]
            sequence.append(length)
            if space > length:
                by_space.setdefault(space - length, []).append(sequence)
    return out


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Configurations with multiplicities whose lengths add up to exactly `counts`."""
    counts = {k: v for k, v in counts.items() if v}
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError("a length is not in 1..capacity")
    rest, plan = dict(counts), []
    if not counts:
        return plan

    def use(config: dict[int, int], most: int) -> bool:
        n = min(most, min(rest[k] // v for k, v in config.items()))
        if n > 0:
            plan.append((tuple(sorted(config.items(), reverse=True)), n))
            for k, v in config.items():
                rest[k] -= n * v
        return n > 0

    every = np.array(sorted(counts))
    price = np.zeros(len(every))
    for _ in range(SOLVES):  # whole parts of the program, then of the program of what they leave
        left = {k: v for k, v in rest.items() if v}
        if len(left) < 2 or sum(left.values()) <= FEW:
            break
        program = solve_program(left, capacity)
        price[np.searchsorted(every, sorted(left))] = program.price
        taken = [use(dict(c), int(program.cover[c])) for c in sorted(program.cover, key=lambda c: (-program.cover[c], c)) if program.cover[c] >= 1]
        if not any(taken):
            break
    tilt = np.maximum(price, 1e-9) * (every / capacity) ** (CONVEX - 1)
    while sum(v > 0 for v in rest.values()) > 1 and sum(rest.values()) > FEW:
        left = np.array([rest[x] > 0 for x in every.tolist()])
        config = best_configuration(every[left], tilt[left], capacity)
        config = {k: min(v, rest[k]) for k, v in config.items()}
        space = capacity - sum(k * v for k, v in config.items())
        for k in sorted((k for k in rest if rest[k]), reverse=True):  # where the rest had too few
            n = min(space // k, rest[k] - config.get(k, 0))
            if n > 0:
                config[k] = config.get(k, 0) + n
                space -= n * k
        use(config, 1 << 62)
    for sequence in best_fit(rest, capacity):
        plan.append((tuple((k, sequence.count(k)) for k in sorted(set(sequence), reverse=True)), 1))
    return plan


def _places(plan: list[tuple[Configuration, int]]) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks: where they begin, the first sequence, how many sequences, the first offset."""
    rows, taken, sequence = [], {}, 0
    for config, n in plan:
        offset = 0
        for length, times in config:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, n, offset))
            taken[length] = first + n * times
            offset += length * times
        sequence += n
    rows.sort()
    return dict(zip(("length", "first", "sequence", "n", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def _pieces(path: str, capacity: int):
    """Pieces of each document; rank counts equal lengths within a task."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, ids in encoded(batches, path):
            n = np.array([len(x) // 4 for x in ids], np.int64)
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = (n - 1) % capacity + 1  # only the first piece is shorter
            start = np.where(number == 0, 0, head[doc] + (number - 1) * capacity)
            length = np.where(number == 0, head[doc], capacity)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            crc = [zlib.crc32(ids[d][4 * s : 4 * (s + k)]) for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def _assign(places: dict[str, np.ndarray]):
    key = places["length"] << 44 | places["first"]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            index = rank - places["first"][at]
            n = np.maximum(places["n"][at], 1)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(places["sequence"][at] + index % n), pa.array(places["offset"][at] + length * (index // n))], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id. Repeated rows are packed as often as they stand there;
    a null doc_id stays null; an empty table gives no rows; other columns are ignored."""
    pieces = cut(arrow(with_texts(docs), _pieces(tokenizer or tokenizer_path(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"), "pieces")
    counts = cut(pieces.groupBy("part", "length").count(), "piece-counts")
    histogram = {int(k): int(v) for k, v in counts.groupBy("length").agg(F.sum("count")).collect()}  # `capacity` rows at most
    places = _places(pack_histogram(histogram, capacity))
    before = counts.select("part", "length", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    ranked = pieces.join(before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    return arrow(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), _assign(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
