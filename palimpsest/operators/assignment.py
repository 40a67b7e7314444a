"""Tasks for people by skills: an auction over classes of equal tasks and equal people.

A person may take a task if they have at least half of the skills it asks for. A person has seats for as many tasks as
their capacity, and no two tasks of high priority of a project. The sum of the fits (shares of skills) is largest but for
``step`` a task. Tasks of one project and one set of skills are a class, so are people; what is auctioned are seats of a
class, so that the auction is one of classes and their links, whatever the number of tasks in a class. A class with free
tasks looks at the cheapest seats it may take, bids for the best of them what it would lose by taking the next best, and
each class of seats keeps its highest bids. Prices only rise, by ``step`` at least, which ends the auction; seats that
nobody took cost nothing, which makes its end the best but for ``step`` a task.

Projects are markets of their own. One whose links a task can hold is settled in a task, class after class. The classes
of larger ones bid all at once, in rounds that are staged tables; the last of them, that outbid each other by a step at a
time, take many rounds there.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import discard, stage_table
from .snapshots import ranked

#: The least share of a task's skills that a person must have; the weights of a confidence.
LEAST_FIT = 0.5
SATISFACTION, GAIN, STABILITY = 0.5, 0.3, 0.2
#: Fits and prices are whole millionths.
UNIT = 1_000_000
#: Places of a class that are joined with the seats they got at a time.
CHUNK = 256
TASK_ROWS = 500_000
#: Links of classes of tasks and of seats, at some 200 bytes each, that one task settles.
TASK_LINKS = 500_000
MAX_ROUNDS = 100_000


def _classes(rows: DataFrame, *by: str) -> DataFrame:
    """project, id, skills (each once, in order), ``by`` and class; rows without an id go, a null project is the empty one."""
    skills = F.array_sort(F.array_distinct(F.filter(F.coalesce("skills", F.array().cast("array<string>")), lambda s: s.isNotNull())))
    named = rows.filter("id IS NOT NULL").select(F.coalesce(F.col("project").cast("string"), F.lit("")).alias("project"), "id", skills.alias("skills"), *by)
    key = [c for c in ("project", "skills", "high") if c in named.columns]
    return named.withColumn("class", F.md5(F.to_json(F.struct(*key))))


def _workload(tasks: DataFrame) -> DataFrame:
    return _classes(tasks.withColumn("high", F.coalesce("high", F.lit(False))), "high")


def _staff(people: DataFrame) -> DataFrame:
    """People with a capacity; a missing one is 1, without any they go."""
    return _classes(people.withColumn("capacity", F.coalesce(F.col("capacity").cast("int"), F.lit(1))), "capacity").filter("capacity > 0")


def _fits(work: DataFrame, staff: DataFrame) -> DataFrame:
    """(class, high, other, fit) of classes of tasks (class, project, skills, high) and of people (other, project, skills) that may take them.

    Who has half of the skills has one of any half of them and one more, so that classes meet in their rarest skills only.
    """
    known = staff.select("project", F.explode("skills").alias("skill"), "other", F.col("skills").alias("has"))
    rare = known.groupBy("project", "skill").agg(F.count("*").alias("n"))
    asked = work.filter(F.size("skills") > 0).select("class", "high", "project", "skills", F.explode("skills").alias("skill")).join(rare, ["project", "skill"], "left")
    sought = asked.groupBy("class", "high", "project").agg(F.first("skills").alias("skills"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "skill"))).alias("by"))
    enough = F.size("skills") - F.ceil(F.size("skills") * LEAST_FIT).cast("int") + 1
    probes = sought.select("class", "high", "project", "skills", F.explode(F.slice("by", F.lit(1), enough)).alias("x")).select("class", "high", "project", "skills", "x.skill")
    met = probes.join(known, ["project", "skill"]).select("class", "high", "other", "skills", "has").dropDuplicates(["class", "other"])
    shared = F.size(F.array_intersect("skills", "has"))
    found = met.filter(shared >= F.size("skills") * LEAST_FIT).select("class", "high", "other", F.floor(shared * UNIT / F.size("skills")).cast("long").alias("fit"))
    # whoever asks for nothing: two classes of a project at most
    anyone = work.filter(F.size("skills") == 0).join(staff.select("project", "other"), "project").select("class", "high", "other", F.lit(UNIT).cast("long").alias("fit"))
    return found.unionByName(anyone)


def eligible(tasks: DataFrame, people: DataFrame) -> DataFrame:
    """(project, id, eligible, best): of each task how many people may take it, and the best share of its skills among them (null: nobody)."""
    work, staff = _workload(tasks), _staff(people)
    kinds = staff.groupBy(F.col("class").alias("other"), "project", "skills").agg(F.count("*").alias("people"))
    fits = _fits(work.select("class", "project", "skills", "high").dropDuplicates(["class"]), kinds).join(kinds.select("other", "people"), "other")
    found = fits.groupBy("class").agg(F.sum("people").alias("eligible"), (F.max("fit") / UNIT).alias("best"))
    return work.join(found, "class", "left").select("project", "id", F.coalesce("eligible", F.lit(0)).cast("long").alias("eligible"), "best")


def _slot(other: Column, first: Column) -> Column:
    """A person's first seat may take a task of high priority, the further ones may not."""
    return F.concat(other, F.when(first, F.lit(":first")).otherwise(F.lit(":further")))


def _round(state: DataFrame, links: DataFrame, slots: DataFrame, step: int) -> DataFrame:
    """The state (class, slot, n, price) after one round; rows without a slot are free tasks."""
    held, free = state.filter("slot IS NOT NULL"), state.filter("slot IS NULL").select("class", F.col("n").alias("free"))
    used = held.groupBy("slot").agg(F.sum("n").alias("used"))
    spare = slots.join(used, "slot", "left").select("slot", F.lit(None).cast("string").alias("holder"), F.lit(0).cast("long").alias("price"), (F.col("supply") - F.coalesce("used", F.lit(0))).alias("n")).filter("n > 0")
    offers = spare.unionByName(held.select("slot", F.col("class").alias("holder"), "price", "n"))
    # one's own seats aside, two offers are looked at
    cheapest = offers.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy("price", F.asc_nulls_first("holder")))).filter("rank <= 3")
    low = cheapest.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("rank", "holder", "price", "n"))).alias("low"))
    seen = links.join(free, "class").join(low, "slot").withColumn("low", F.filter("low", lambda o: ~o["holder"].eqNullSafe(F.col("class"))))
    first, second = F.get("low", F.lit(0)), F.get("low", F.lit(1))
    seen = seen.select("class", "slot", "free", "fit", (F.col("fit") - first["price"]).alias("net"), (F.col("fit") - second["price"]).alias("next"), first["n"].alias("n")).filter(F.col("net") >= step)
    order = Window.partitionBy("class").orderBy(F.desc("net"), "slot")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("got", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("bar", F.coalesce(F.max("next").over(before), F.lit(0)))
    takes = (F.col("got") < F.col("free")) & (F.col("net") >= F.col("bar"))
    seen = seen.withColumn("take", F.when(takes, F.least(F.col("n"), F.col("free") - F.col("got"))).otherwise(0))
    rest = F.when(F.col("take") < F.col("n"), F.col("net")).otherwise(F.coalesce("next", F.lit(0)))
    gain = seen.groupBy("class").agg(F.greatest(F.max(rest) - step, F.lit(0)).alias("gain"), F.sum("take").alias("taken"))
    # a class that finds nothing gives its free tasks up and values its seats at all they are worth
    turn = free.join(gain, "class", "left").select("class", F.coalesce("gain", F.lit(0)).alias("gain"), F.when(F.col("taken").isNull(), F.lit(0)).otherwise(F.col("free") - F.col("taken")).alias("left"))
    bids = seen.filter("take > 0").join(gain.select("class", "gain"), "class").select("class", "slot", F.col("take").alias("n"), (F.col("fit") - F.col("gain")).alias("price"))
    dearer = held.join(turn.select("class", "gain"), "class", "left").join(links, ["class", "slot"]).select("class", "slot", "n", F.greatest(F.col("price"), F.col("fit") - F.col("gain")).alias("price"))
    all_ = dearer.withColumn("new", F.lit(0)).unionByName(bids.withColumn("new", F.lit(1))).join(slots, "slot")
    above = Window.partitionBy("slot").orderBy(F.desc("price"), "new", "class").rowsBetween(Window.unboundedPreceding, -1)
    all_ = all_.withColumn("keep", F.greatest(F.lit(0), F.least(F.col("n"), F.col("supply") - F.coalesce(F.sum("n").over(above), F.lit(0)))))
    kept = all_.groupBy("class", "slot").agg(F.sum("keep").alias("n"), F.max("price").alias("price"), F.sum(F.col("n") - F.col("keep")).alias("lost"))
    # kept and lost tasks leave one shuffle as rows of one kind, summed by class and slot
    rows = F.array(F.struct("slot", "n", "price"), F.struct(F.lit(None).cast("string").alias("slot"), F.col("lost").alias("n"), F.lit(None).cast("long").alias("price")))
    after = kept.select("class", F.explode(rows).alias("x")).select("class", "x.slot", "x.n", "x.price")
    after = after.unionByName(turn.select("class", F.lit(None).cast("string").alias("slot"), F.col("left").alias("n"), F.lit(None).cast("long").alias("price")))
    return after.groupBy("class", "slot").agg(F.sum("n").cast("long").alias("n"), F.max("price").alias("price")).filter("n > 0")


def _market(links: pd.DataFrame, step: int) -> pd.DataFrame:
    """The settled (class, slot, n, price) of one project's ``links`` (class, n, slot, fit, supply)."""
    fits, free, spare = defaultdict(list), {}, {}
    for class_, n, slot, fit, supply in links.sort_values(["class", "slot"])[["class", "n", "slot", "fit", "supply"]].itertuples(index=False):
        fits[class_].append((slot, fit))
        free[class_], spare[slot] = n, supply
    held: dict[str, dict[str, list[int]]] = {slot: {} for slot in spare}  # n and price by class
    turns = deque(free)
    while turns:
        class_ = turns.popleft()
        wanted, offers = free.pop(class_), []
        for slot, fit in fits[class_]:
            if spare[slot]:
                offers.append((-fit, slot, "", spare[slot]))
            offers += [(price - fit, slot, other, n) for other, (n, price) in held[slot].items() if other != class_]
        offers, takes, rest = sorted(o for o in offers if -o[0] >= step), [], 0
        for loss, slot, other, n in offers:
            if not wanted:
                rest = -loss
                break
            got = min(n, wanted)
            takes.append((slot, other, got))
            wanted -= got
            if got < n:
                rest = -loss
                break
        gain = max(rest - step, 0)
        for slot, fit in fits[class_]:
            if mine := held[slot].get(class_):
                mine[1] = max(mine[1], fit - gain)
        worth = dict(fits[class_])
        for slot, other, n in takes:
            if not other:
                spare[slot] -= n
            else:
                held[slot][other][0] -= n
                if not held[slot][other][0]:
                    del held[slot][other]
                if other not in free:
                    free[other] = 0
                    turns.append(other)
                free[other] += n
            mine = held[slot].setdefault(class_, [0, 0])
            mine[0], mine[1] = mine[0] + n, max(mine[1], worth[slot] - gain)
    return pd.DataFrame([(c, slot, n, price) for slot, by in held.items() for c, (n, price) in by.items()], columns=["class", "slot", "n", "price"])


def _settled(demand: DataFrame, links: DataFrame, slots: DataFrame, step: int) -> DataFrame:
    """The state of projects whose links a task holds; classes without links hold nothing."""
    rows = links.join(demand.select("class", "project", "n"), "class").join(slots, "slot").select("project", "class", "n", "slot", "fit", "supply")
    return rows.groupBy("project").applyInPandas(lambda f: _market(f, step), "class string, slot string, n long, price long")


def assigned(tasks: DataFrame, people: DataFrame, step: float = 0.05, task_links: int = TASK_LINKS) -> DataFrame:
    """(project, id, assignee, fit): whom each task goes to, and the share of its skills that they have; nulls where nobody can take it.

    ``tasks`` has project, id, skills, high (null: not); ``people`` project, id, skills, capacity (null: 1). Ids are unique within
    their table. Skills count once, null ones not; tasks without skills fit anyone of their project. The sum of the fits is
    within ``step`` a task of the largest. Equal tasks get their seats in the order of their ids, so that reruns agree.
    Projects of more than ``task_links`` links of classes take rounds of the whole cluster.
    """
    work, staff = stage_table(_workload(tasks), "work"), stage_table(_staff(people), "staff")
    kinds = staff.groupBy(F.col("class").alias("other"), "project", "skills").agg(F.count("*").alias("people"), F.sum("capacity").alias("seats"))
    kinds = stage_table(kinds, "people")
    demand = work.groupBy("class", "project", "skills", "high").agg(F.count("*").alias("n"))
    both = F.explode(F.array(F.lit(True), F.lit(False)))
    slots = kinds.select("other", "people", "seats", both.alias("first")).select(_slot(F.col("other"), F.col("first")).alias("slot"), F.when(F.col("first"), F.col("people")).otherwise(F.col("seats") - F.col("people")).alias("supply"))
    slots = stage_table(slots.filter("supply > 0"), "slots")
    links = _fits(demand, kinds).select("class", "high", "other", "fit", both.alias("first")).filter("first OR NOT high").select("class", _slot(F.col("other"), F.col("first")).alias("slot"), "fit")
    links = stage_table(links.join(slots.select("slot"), "slot", "left_semi"), "links")
    millionths = max(1, round(step * UNIT))
    sizes = links.join(demand.select("class", "project"), "class").groupBy("project").count()
    demand = stage_table(demand.join(sizes, "project", "left").withColumn("large", F.coalesce(F.col("count") > task_links, F.lit(False))), "demand")
    settled = stage_table(_settled(demand.filter("NOT large"), links, slots, millionths), "settled")
    state = stage_table(demand.filter("large").select("class", F.lit(None).cast("string").alias("slot"), "n", F.lit(None).cast("long").alias("price")), "auction")
    for _ in range(MAX_ROUNDS):
        size, open_ = state.agg(F.count("*"), F.count_if(F.col("slot").isNull())).first()
        if not open_:
            break
        old, state = state, stage_table(_round(state, links, slots, millionths), "auction", files=1 + size // TASK_ROWS)
        discard(old)
    else:
        raise RuntimeError("the auction did not settle")
    discard(kinds, slots, demand)
    sums = lambda by, then: F.sum("n").over(Window.partitionBy(by).orderBy(then)) - F.col("n")
    flows = state.unionByName(settled).join(links, ["class", "slot"]).select("class", "slot", "n", "fit", sums("class", "slot").alias("from"), sums("slot", "class").alias("seat"))
    spread = flows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("from") / CHUNK), F.floor((F.col("from") + F.col("n") - 1) / CHUNK))))
    placed = ranked(work.select("class", "project", "id"), "class", ["id"], "place").withColumn("place", F.col("place") - 1)
    at = placed.withColumn("chunk", F.floor(F.col("place") / CHUNK)).alias("a")
    lies = (F.col("a.class") == F.col("f.class")) & (F.col("a.chunk") == F.col("f.chunk")) & (F.col("place") >= F.col("from")) & (F.col("place") < F.col("from") + F.col("n"))
    got = at.join(spread.alias("f"), lies, "left").select("project", "id", "slot", "fit", (F.col("seat") + F.col("place") - F.col("from")).alias("seat"))
    # everybody's first seats, then everybody's second ones
    chairs = staff.select("id", "class", F.explode(F.sequence(F.lit(1), "capacity")).alias("nth")).select(F.col("id").alias("assignee"), _slot(F.col("class"), F.col("nth") == 1).alias("slot"), "nth")
    chairs = ranked(chairs, "slot", ["nth", "assignee"], "seat").select("assignee", "slot", (F.col("seat") - 1).alias("seat"))
    return got.join(chairs, ["slot", "seat"], "left").select("project", "id", "assignee", (F.col("fit") / UNIT).alias("fit"))


def resolution(assigned: DataFrame) -> DataFrame:
    """(project, tasks, assigned, satisfied, score) of ``assigned``: whether every task of a project has somebody, and the mean fit, 0 for tasks without."""
    return assigned.groupBy("project").agg(
        F.count("*").alias("tasks"), F.count("assignee").alias("assigned"), (F.count("*") == F.count("assignee")).alias("satisfied"), F.avg(F.when(F.col("assignee").isNull(), 0.0).otherwise(F.col("fit"))).alias("score")
    )


def confidence(satisfaction: Column, last: Column, before: Column) -> Column:
    """Of a resolution whose last scores were ``before`` and ``last`` (null: none): half its satisfaction, three tenths the gain over the last, and a fifth
    the cosine of the last two scores and the last with this one; 1 without two of them, null where one of both is all zeros.
    """
    gain = F.coalesce(F.greatest(F.lit(0.0), satisfaction - last), F.lit(0.0))
    sizes = F.sqrt(before * before + last * last) * F.sqrt(last * last + satisfaction * satisfaction)
    cosine = F.when(sizes > 0, (before * last + last * satisfaction) / F.when(sizes > 0, sizes))
    return SATISFACTION * satisfaction + GAIN * gain + STABILITY * F.when(last.isNull() | before.isNull(), 1.0).otherwise(cosine)
