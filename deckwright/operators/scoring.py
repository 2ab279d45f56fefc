"""Score methods: each takes the features of a whole population of cards and gives a score per card.

A feature the source doesn't know is NULL, and a card whose score can't be computed has NULL, never zero.
Scores are unrounded; :data:`METHODS` is the registry.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.places import midranks
from ..functions.stats import blend, num, rate, saturation, shrink
from . import usage
from .cohort import Cohort

#: Prior sizes and weights of the methods.
CONSTRUCTED = {"games": 60.0, "decks": 20.0, "weights": (0.60, 0.25, 0.15)}
SIGNATURE = {"labelled": 10.0, "decks": 10.0, "games": 60.0, "weights": (0.50, 0.30, 0.20)}
HIDDEN_GEM = {"games": 100.0, "decks": 20.0, "playsets": 5.0, "weights": (0.70, 0.30), "recurrence": 2.0, "rarity": 0.02, "least_playsets": 0.05}
STAPLE_INCIDENCE = 0.35
OVERALL = {"decks": 250.0, "weight": 1.0, "score": 50.0}


def features(cohort: Cohort, facts: DataFrame) -> DataFrame:
    """Per run and card: usage, concentration, home archetype and the field's values beside them."""
    players = F.col("players_per_game")
    cards = usage.card_usage(facts, *usage.early_late()).withColumn("win_rate", usage.win_rate(players)).withColumn("games", usage.games())
    field = usage.field(cohort, *usage.early_late()).withColumn("field_win", usage.win_rate(players))
    field = field.join(usage.concentration(cohort.decks, "format").drop("labelled"), "format", "left").select(
        "format", F.col("deck_count").alias("field_decks"), "field_win", rate(F.col("cut_made"), F.col("cut_known")).alias("field_cut"), F.col("concentration").alias("field_concentration"), F.col("early").alias("field_early"), F.col("late").alias("field_late")
    )
    keys = ["format", "card_id"]
    sizes = usage.counted(cohort.decks.where(F.col("label").isNotNull()), "format", "label").select("format", F.col("label").alias("home"), F.col("decks").alias("home_decks"))
    # both sides of the first join are grouped by its keys already; the fact table is read twice in all
    profile = cards.join(usage.label_profile(facts, *keys), keys, "left").join(sizes, ["format", "home"], "left")
    # one row a run
    return profile.join(F.broadcast(field), "format").withColumn("incidence", rate(F.col("deck_count"), F.col("field_decks")))


def performance(rows: DataFrame) -> DataFrame:
    """Win-rate delta with the half-width of its interval, cut lift and share delta."""
    w = F.col("win_rate")
    half = num(1.96) * F.sqrt(F.greatest(w * (num(1) - w), num(0)) / F.nullif(F.col("games").cast("double"), num(0)))
    lift = rate(F.col("cut_made"), F.col("cut_known")) / F.nullif(F.col("field_cut"), num(0))
    share = rate(F.col("late"), F.col("field_late")) - rate(F.col("early"), F.col("field_early"))
    return rows.select("format", "card_id", "games", "win_rate", (w - F.col("field_win")).alias("win_delta"), F.when(w.isNotNull(), half).alias("win_ci95"), lift.alias("cut_lift"), share.alias("share_delta"))


def shrunk_win(prior: float) -> Column:
    return F.when(F.col("games") > 0, shrink(F.col("win_rate"), F.col("games"), F.col("field_win"), prior))


def shrunk_cut(prior: float) -> Column:
    own = rate(F.col("cut_made"), F.col("cut_known"))
    return F.when((F.col("cut_known") > 0) & (F.col("field_cut") != 0), shrink(own, F.col("cut_known"), F.col("field_cut"), prior) / F.col("field_cut"))


def constructed(rows: DataFrame) -> DataFrame:
    """Win rate, cut rate and incidence, each as a percentile."""
    parts = {"a": shrunk_win(CONSTRUCTED["games"]) - F.col("field_win"), "b": shrunk_cut(CONSTRUCTED["decks"]), "c": F.col("incidence")}
    ranked = midranks(rows.select("format", "card_id", *[v.alias(k) for k, v in parts.items()]), list(parts), "format")
    mixed = ranked.select("format", "card_id", blend(list(zip(CONSTRUCTED["weights"], (F.col("p_a"), F.col("p_b"), F.col("p_c")), strict=True))).alias("blend"))
    return midranks(mixed, ["blend"], "format").select("format", "card_id", (num(100) * F.col("p_blend")).alias("score"))


def signature(rows: DataFrame) -> DataFrame:
    """How much one archetype a card's home is; only cards with one are scored."""
    support, own = F.col("home_support").cast("double"), F.col("home_decks").cast("double")
    adoption = (support + num(SIGNATURE["decks"]) * F.col("incidence")) / (own + num(SIGNATURE["decks"]))
    n = F.when(F.col("concentration").isNull(), num(0)).otherwise(F.col("labelled").cast("double"))
    focus = shrink(F.coalesce("concentration", num(0)), n, F.col("field_concentration"), SIGNATURE["labelled"])
    parts = {"a": focus, "b": adoption - F.col("incidence"), "c": shrunk_win(SIGNATURE["games"]) - F.col("field_win")}
    known = midranks(rows.where(F.col("home").isNotNull()).select("format", "card_id", *[v.alias(k) for k, v in parts.items()]), list(parts), "format")
    mixed = known.select("format", "card_id", "a", blend(list(zip(SIGNATURE["weights"], (F.col("p_a"), F.col("p_b"), F.col("p_c")), strict=True))).alias("blend"))
    return midranks(mixed, ["blend"], "format").select("format", "card_id", (num(100) * F.col("p_blend")).alias("score"), (num(1) / F.col("a")).alias("effective_archetypes"))


def hidden_gem(rows: DataFrame) -> DataFrame:
    """Rare cards that win: lift times playset share, recurrence and rarity; a gem of no lift scores 0."""
    rows = cut(rows)
    pooled = rows.groupBy("format").agg(rate(F.sum("playsets"), F.sum("deck_count")).alias("pooled"))  # one row a run
    win = F.when(F.col("field_win") != 0, shrunk_win(HIDDEN_GEM["games"]) / F.col("field_win") - num(1))
    lift = blend([(HIDDEN_GEM["weights"][0], win), (HIDDEN_GEM["weights"][1], shrunk_cut(HIDDEN_GEM["decks"]) - num(1))])
    playsets = (F.col("playsets").cast("double") + num(HIDDEN_GEM["playsets"]) * F.col("pooled")) / (F.col("deck_count").cast("double") + num(HIDDEN_GEM["playsets"]))
    events = F.col("event_count").cast("double")
    recurrence = events / (events + num(HIDDEN_GEM["recurrence"]))
    rarity = num(1) / (num(1) + F.col("incidence") / num(HIDDEN_GEM["rarity"]))
    gems = rows.join(F.broadcast(pooled), "format").withColumn("gem", F.when(F.col("pooled") >= num(HIDDEN_GEM["least_playsets"]), lift * playsets * recurrence * rarity))
    ranked = midranks(gems.select("format", "card_id", "gem", F.when(F.col("gem") > 0, F.col("gem")).alias("good")), ["good"], "format")
    return ranked.select("format", "card_id", F.when(F.col("gem") > 0, num(100) * F.col("p_good")).when(F.col("gem") <= 0, num(0)).alias("score"))


def max_ratio(rows: DataFrame, measure: str = "deck_count") -> DataFrame:
    """A count against the greatest in the run."""
    rows = cut(rows.select("format", "card_id", measure))
    most = rows.groupBy("format").agg(F.max(measure).alias("most"))  # one row a run
    return rows.join(F.broadcast(most), "format").select("format", "card_id", (num(100) * rate(F.col(measure), F.col("most"))).alias("score"))


def foundation(rows: DataFrame) -> DataFrame:
    """Staple, build-around and evidence.  Of the observations behind the first two, sources fill only the
    incidence; what isn't known neither counts as zero nor takes weight, but lowers the coverage."""
    clamp = lambda x: F.least(num(100), F.greatest(num(0), x))
    covered = F.when(F.col("incidence").isNotNull(), num(STAPLE_INCIDENCE)).otherwise(num(0))
    staple = clamp(F.when(covered > 0, num(100) * F.col("incidence")).otherwise(num(0)))
    evidence = num(30) * saturation(F.col("deck_count"), 8) + num(25) * saturation(F.col("event_count"), 4) + num(10) * (covered + num(0)) / num(2)
    return rows.select("format", "card_id", staple.alias("staple"), num(0).alias("buildaround"), clamp(evidence).alias("evidence"), (num(0) - staple).alias("delta"), (num(100) * covered).alias("staple_coverage"), num(0).alias("buildaround_coverage"))


def overall(scores: DataFrame) -> DataFrame:
    """Across runs: (card_id, format, score, decks) to a percentile of the evidence-weighted mean.  A card's
    runs are summed in the order of their format, so that the sum is the same on every engine."""
    graded = scores.where(F.col("score").isNotNull() & (F.col("decks") > 0))
    w = F.col("decks").cast("double") / (F.col("decks").cast("double") + num(OVERALL["decks"]))
    part = graded.select("card_id", F.struct("format", w.alias("w"), (w * F.col("score")).alias("ws")).alias("part"), "decks")
    each = part.groupBy("card_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.count("*").alias("formats"), F.sum("decks").alias("decks"))
    fold = lambda k: F.aggregate("parts", num(0), lambda a, x: a + x[k])
    mixed = each.withColumns({"evidence": fold("w"), "total": fold("ws")}).withColumn("blend", (F.col("total") + num(OVERALL["weight"] * OVERALL["score"])) / (F.col("evidence") + num(OVERALL["weight"])))
    return midranks(mixed, ["blend"]).select("card_id", "formats", "decks", "evidence", (num(100) * F.col("p_blend")).alias("score"))


def pooled_usage(rows: DataFrame) -> DataFrame:
    """Across runs: counts added; the win delta as each run's gap to its field, weighted by games; the lift as
    observed over expected cuts, of the runs whose field's rate is known and not zero."""
    counted = F.col("cut_made").isNotNull() & (F.col("field_cut") != 0)
    expected = F.when(counted, F.col("cut_known").cast("double") * F.col("field_cut"))
    rows = rows.withColumn("lift_made", F.when(counted, F.col("cut_made")))
    played = (F.col("games") > 0) & (F.col("win_rate") - F.col("field_win")).isNotNull()
    gap = F.when(played, (F.col("win_rate") - F.col("field_win")) * F.col("games").cast("double"))
    rows = rows.withColumn("delta_games", F.when(played, F.col("games")))
    each = rows.select("card_id", F.struct("format", expected.alias("e"), gap.alias("g")).alias("part"), "lift_made", "delta_games", "deck_count", "event_count", "copies", "playsets", "cut_known", "cut_made", "wins", "losses", "draws")
    sums = [F.sum(c).cast("long").alias(c) for c in ("lift_made", "delta_games", "deck_count", "event_count", "copies", "playsets", "cut_known", "cut_made", "wins", "losses", "draws")]
    fold = lambda k: F.aggregate("parts", num(0), lambda a, x: a + F.coalesce(x[k], num(0)))
    out = each.groupBy("card_id").agg(*sums, F.array_sort(F.collect_list("part")).alias("parts")).withColumns({"expected": fold("e"), "gap": fold("g")})
    out = out.withColumns({"cut_lift": F.col("lift_made").cast("double") / F.nullif(F.col("expected"), num(0)), "win_delta": rate(F.col("gap"), F.col("delta_games"))})
    return out.drop("parts", "gap", "lift_made", "delta_games")


Method = Callable[[DataFrame], DataFrame]
METHODS: dict[str, tuple[Method, Sequence[str]]] = {
    "constructed": (constructed, ("score",)),
    "signature": (signature, ("score", "effective_archetypes")),
    "hidden-gem": (hidden_gem, ("score",)),
    "max-ratio": (max_ratio, ("score",)),
    "foundation": (foundation, ("staple", "buildaround", "evidence", "delta", "staple_coverage", "buildaround_coverage")),
}


#: What a method's identity covers besides its outputs.
CONFIG = {"constructed": CONSTRUCTED, "signature": SIGNATURE, "hidden-gem": HIDDEN_GEM, "foundation": {"incidence": STAPLE_INCIDENCE}, "max-ratio": {}}


def run_method(name: str, rows: DataFrame) -> DataFrame:
    """A registered method; its output must be the columns that it declares."""
    method, outputs = METHODS[name]
    out = method(rows)
    if out.columns != ["format", "card_id", *outputs]:
        raise ValueError(f"{name} gives {out.columns}")
    return out


def identity(name: str, version: str = "1") -> tuple[str, str, str]:
    """A registered method's name, version and the hash of all that it is configured by, so that runs of other weights or
    priors are other runs."""
    outputs = METHODS[name][1]
    config = CONFIG[name] | {"outputs": list(outputs)}
    return name, version, hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=list).encode()).hexdigest()


def long_scores(name: str, rows: DataFrame) -> DataFrame:
    """(format, method, card_id, output, value): a method's outputs, a row each."""
    out = run_method(name, rows)
    each = F.array(*[F.struct(F.lit(c).alias("output"), F.col(c).cast("double").alias("value")) for c in METHODS[name][1]])
    return out.select("format", F.lit(name).alias("method"), "card_id", F.explode(each).alias("x")).select("format", "method", "card_id", "x.*")
