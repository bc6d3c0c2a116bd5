"""Caption and answer text as column expressions, and the few word walks that need Python."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and markers that results depend on.
LOCATION_MARKERS = [
    ", located", ", positioned", ", situated", ", standing", ", facing",
    " located", " positioned", " situated", " standing", " facing",
    " is located", " is positioned", " is situated", " is standing",
    " stands", " is facing", " faces", " is walking", " walking on",
    ", walking in", ". ",
]
DETERMINERS = ["The ", "A ", "An ", "This ", "These ", "Their "]
SPATIAL_CUE = (
    r"(?i)\b(?:left|right|front|behind|back|ahead|rear|near|nearby|far|farther|farthest|closest|nearest|between|above|below|beside|adjacent|"
    r"opposite|center|centre|middle|edge|view|image|observer|distance|direction|side|located|positioned|situated)\b"
)
VIEWS = {"0": "front view", "1": "front-left view", "2": "front-right view", "3": "side-left view", "4": "side-right view"}
RELATION_PHRASES = {"left": "to the left of", "right": "to the right of", "front": "in front of", "behind": "behind", "closer_to": "closer to", "gets_closer_to": "gets closer to", "does_not_get_closer_to": "does not get closer to", "distance_from": "distance from"}
OPPOSITE = {"left": "right", "right": "left", "front": "behind", "behind": "front", "gets_closer_to": "does_not_get_closer_to", "does_not_get_closer_to": "gets_closer_to"}


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once a row, however often ``of`` names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def normalize_caption(text: Column) -> Column:
    """A blank before each comma, single blanks elsewhere."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(","), F.lit(" ,")), r"\s+", " "))


def format_caption(text: Column) -> Column:
    return F.concat(F.lit(" "), normalize_caption(text), F.lit(" "))


def clean_utterance(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r" \. not mentioned$", ""), F.lit(" ,"), F.lit(","))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_expression(text: Column) -> Column:
    """The noun phrase at the head of a caption: before the first marker of a location."""
    whole = F.regexp_replace(squeeze(text), r"\.+$", "")
    rest = F.when(F.lower(whole).startswith("this is "), F.substr(whole, F.lit(9))).otherwise(whole)
    at = [F.when(F.instr(rest, m) > 1, F.instr(rest, m) - 1) for m in LOCATION_MARKERS]
    cut = F.substr(rest, F.lit(1), F.coalesce(F.least(*at), F.length(rest)))
    plain = F.regexp_replace(F.trim(cut), r"^[,; ]+|[,; ]+$", "")
    kind = F.lower(F.trim(F.regexp_extract(whole, r"(?i)^object type:\s*([^,;]+)", 1)))
    features = F.regexp_replace(F.trim(F.regexp_extract(whole, r"(?i)appearance features?\s*[:;]\s*([^;]+)", 1)), r"[,; ]+$", "")
    short = F.when(F.lower(whole).startswith("object type:"), F.trim(F.concat_ws(" ", kind, features))).otherwise(plain)
    return F.when(F.length(short) < 3, whole).otherwise(short)


def neutral_phrase(caption: Column) -> Column:
    """Struct (phrase, reason): the short expression, or why it can't be used."""
    phrase = F.regexp_replace(squeeze(short_expression(caption)), r"^[ ,.;:]+|[ ,.;:]+$", "")
    reason = F.when(F.length(phrase) < 8, "too_short").when(F.length(phrase) > 180, "too_long").when(F.rlike(phrase, F.lit(SPATIAL_CUE)), "spatial_cue").otherwise("accepted")
    return F.struct(F.when(reason == "accepted", phrase).alias("phrase"), reason.alias("reason"))


def question_form(short: Column) -> Column:
    """A leading determiner in lower case."""
    hit = F.lit(False)
    for d in DETERMINERS:
        hit = hit | short.startswith(d)
    return F.when(hit, F.concat(F.lower(F.substr(short, F.lit(1), F.lit(1))), F.substr(short, F.lit(2)))).otherwise(short)


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def entity(description: Column, view: Column) -> Column:
    return F.concat(F.lit("the "), description, F.lit(" in the "), view)


def view_of(frame: Column) -> Column:
    """View name by the last _-part of a frame's name."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in VIEWS.items() for x in kv])[F.element_at(F.split(frame, "_"), -1)], F.lit("camera view"))


def view_degrees(frame: Column) -> Column:
    angles = {"0": 0, "1": -45, "2": 45, "3": -90, "4": 90}
    return F.create_map(*[F.lit(x) for kv in angles.items() for x in kv])[F.element_at(F.split(frame, "_"), -1)]


def without_views(text: Column) -> Column:
    for view in sorted(VIEWS.values(), key=len, reverse=True):
        text = F.replace(text, F.lit(f" in the {view}"), F.lit(""))
    return text


def direction_phrase(relations: Column) -> Column:
    along = F.when(relations[1] == "front", "in front of").otherwise("behind")
    return F.concat(F.lit("to the "), relations[0], F.lit(" and "), along, F.lit(" the reference object"))


def mentions(text: Column, word: Column) -> Column:
    return F.rlike(text, F.concat(F.lit(r"(?i)\b"), word, F.lit(r"\b")))


def spatial_word_counts(caption: Column) -> Column:
    """Whole-word counts of four words, without the zeros."""
    words = ["left", "right", "front", "behind"]
    counted = F.create_map(*[x for w in words for x in (F.lit(w), F.regexp_count(F.lower(caption), F.lit(rf"\b{w}\b")))])
    return F.map_filter(counted, lambda _, n: n > 0)


def only_relation_word(caption: Column) -> Column:
    """The one relation word of a caption (back means behind), null when there are several or none."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(caption), F.lit(r"\b(left|right|front|behind|back)\b"), F.lit(1)))
    return F.when(F.size(found) == 1, F.when(found[0] == "back", "behind").otherwise(found[0]))


def parse_answer(text: Column) -> Column:
    """Struct of lateral, longitudinal, distance and format_ok of a free answer; ambiguity gives null."""
    held = F.coalesce(text, F.lit(""))
    strict = F.regexp_extract_all(F.lower(held), F.lit(r"\bto the (left|right)\b"), F.lit(1))
    loose = F.regexp_extract_all(F.lower(held), F.lit(r"\b(left|right)\b"), F.lit(1))
    sides = F.array_distinct(F.when(F.size(strict) > 0, strict).otherwise(loose))
    lateral = F.when(F.size(sides) == 1, F.get(sides, F.lit(0)))
    front, behind = F.rlike(held, F.lit(r"(?i)\bin front\b")), F.rlike(held, F.lit(r"(?i)\bbehind\b|\bin back of\b"))
    along = F.when(front & ~behind, "front").when(behind & ~front, "behind")
    number = F.regexp_extract(held, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*m(?:eters?)?\b", 1)
    distance = F.when(number != "", number.cast("double"))
    ok = lateral.isNotNull() & along.isNotNull() & distance.isNotNull()
    return F.struct(lateral.alias("lateral"), along.alias("longitudinal"), distance.alias("distance"), ok.alias("format_ok"))


def norm_decimal(text: Column) -> Column:
    """Lower-case words and numbers, decimals kept, single blanks between."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)?"), F.lit(0)), " ")


def norm_plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def in_order(text: Column, entities: Column, held: Column | None = None) -> Column:
    """Whether the entities occur one after the other, each behind the one before. ``held``: the text normalised already."""
    held = norm_decimal(text) if held is None else held
    at = F.aggregate(F.transform(entities, norm_decimal), F.lit(1), lambda at, e: _next(held, e, at))
    return at > 0


def _next(held: Column, entity: Column, at: Column) -> Column:
    found = F.position(entity, held, F.greatest(at, F.lit(1)))
    return F.when((at > 0) & (found > 0), found + F.length(entity)).otherwise(F.lit(0))


def predicate_ok(held: Column, relation: Column) -> Column:
    """The relation's phrase is in a normalised text and its opposite's isn't."""
    ok = F.lit(False)
    for name, phrase in RELATION_PHRASES.items():
        this = F.contains(held, F.lit(phrase))
        if name in OPPOSITE:
            this = this & ~F.contains(held, F.lit(RELATION_PHRASES[OPPOSITE[name]]))
        ok = F.when(relation == name, this).otherwise(ok)
    return ok


def triple_ok(prediction: Column, kind: Column, subject: Column, relation: Column, object: Column, comparison: Column, meters: Column, motion: Column, held: Column | None = None) -> Column:
    """Subject, predicate and object of an answer by the kind of its key. Metric answers hold one number within 0.051 m.

    ``held`` is ``norm_decimal(prediction)``, where a column of it is at hand: it is used many times.
    """
    held = norm_decimal(prediction) if held is None else held
    two = in_order(prediction, F.array(subject, object), held)
    three = in_order(prediction, F.array(subject, object, F.coalesce(comparison, F.lit(""))), held)
    numbers = F.regexp_extract_all(F.lower(prediction), F.lit(r"(?<![a-z0-9])([0-9]+(?:\.[0-9]+)?)\s*meters?\b"), F.lit(1))
    metric = two & (F.size(numbers) == 1) & (F.abs(F.get(numbers, F.lit(0)).cast("double") - meters) < 0.051)
    said = predicate_ok(held, relation)
    moving = two & said & F.contains(held, norm_decimal(F.coalesce(motion, F.lit(""))))
    return F.coalesce(F.when(kind == "metric_distance", metric).when(kind == "relative_distance", three & said).when(kind == "motion_relation", moving).when(kind == "spatial_triple", two & said), F.lit(False))


def one_sentence(text: Column) -> Column:
    """Ends in one of .!? and has no other, decimal points aside."""
    value = F.trim(text)
    bare = F.regexp_replace(value, r"([0-9])\.(?=[0-9])", "$1")
    return F.rlike(value, F.lit(r"[.!?]$")) & (F.regexp_count(bare, F.lit("[.!?]")) == 1)


def one_sentence_strict(text: Column) -> Column:
    value = F.trim(text)
    return value.endswith(".") & (F.regexp_count(value, F.lit("[.!?]")) == 1) & ~value.contains("\n")


def extract_triples(text: Column) -> Column:
    """Sorted distinct "subject relation target" strings of the canonical grammar."""
    pattern = F.lit(r"(?i)object\s+([A-Z])\s+is\s+(.+?)\s+(?:object\s+([A-Z])|the\s+ego\s+vehicle)(?=\s*[,;.]|\s+and\s+object|$)")
    groups = F.arrays_zip(*[F.regexp_extract_all(text, pattern, F.lit(i)).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "t"))])

    def of(g):
        said = F.array_compact(F.array(*[F.when(F.rlike(norm_plain(g["p"]), F.lit(rf"\b{r}\b")), r) for r in ("left", "right", "front", "behind")]))
        target = F.when(g["t"] == "", "EGO").otherwise(F.upper(g["t"]))
        return F.transform(said, lambda r: F.concat_ws(" ", F.upper(g["s"]), r, target))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, of))))


def parsed_key(scenario: Column, text: Column) -> Column:
    """The answer key that a text gives, by scenario."""
    t = norm_plain(text)
    word = lambda w: F.rlike(t, F.lit(rf"\b{w}\b"))
    two, three = F.regexp_extract(t, r"\bobject ([ab])\b", 1), F.regexp_extract(t, r"\bobject ([abc])\b", 1)
    lateral = F.when(word("left"), "left").when(word("right"), "right")
    along = F.when(word("behind"), "behind").when(word("front"), "front")
    range_ = F.when(word("near") & ~word("far"), "near").when(word("far") & ~word("near"), "far")
    both = F.when(lateral.isNotNull() & along.isNotNull(), F.concat(lateral, F.lit("_"), along)).otherwise(F.coalesce(lateral, along))
    return (
        F.when(scenario.isin("closer_of_two", "closer_to_ego", "which_is_left"), F.when(two != "", F.upper(two)))
        .when(scenario == "closest_of_three_to_ego", F.when(three != "", F.upper(three)))
        .when(scenario == "ego_near_far", range_)
        .otherwise(both)
    )


def first_noun(caption: Column, words: Column) -> Column:
    """Struct (start, word) of the earliest word of a list, the longest on ties; null when none occurs as a whole word."""
    at = F.transform(words, lambda w: F.struct(F.regexp_instr(F.lower(caption), F.concat(F.lit(r"\b"), w, F.lit(r"\b"))).alias("start"), (-F.length(w)).alias("short"), w.alias("word")))
    return F.array_min(F.filter(at, lambda m: m["start"] > 0))


def half_even(value: Column, digits: int = 1) -> Column:
    """A number as text by its exact binary value, ties to even; no built-in does this."""

    @F.pandas_udf("string")
    def render(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}")

    return render(value)


MENTIONS = "array<struct<start:int,end:int,word:string>>"


def find_mentions(caption: str | None, words: list[str]) -> list[tuple[int, int, str]]:
    """Whole-word matches from the left, the longer on equal starts, none over another."""
    found = sorted((m.start(), -m.end(), w) for w in words for m in re.finditer(rf"\b{re.escape(w)}\b", caption or "", re.IGNORECASE))
    out: list[tuple[int, int, str]] = []
    for start, end, word in found:
        if not out or start >= out[-1][1]:
            out.append((start, -end, word))
    return out


def category_mentions(caption: Column, words: Column) -> Column:
    """All mentions of a category's words with their places, which no built-in returns."""

    @F.pandas_udf(MENTIONS)
    def find(captions: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "word": w} for s, e, w in find_mentions(c, list(ws))] for c, ws in zip(captions, lists)])

    return find(caption, words)


def summary_part(text: Column) -> Column:
    """What follows the last "Summary:"; the whole text without one."""
    return F.trim(F.element_at(F.split(text, "Summary:"), -1))


def platform_utterance(text: Column, platform: Column, summarised: list[str]) -> Column:
    """The summary alone for platforms whose texts carry one, the text as it is for others."""
    return F.when(platform.isin(summarised), summary_part(text)).otherwise(text)


def plan_phrase_ok(text: Column, kind: Column, safe: Column, steer: Column, pass_side: Column, blocker: Column) -> Column:
    """Whether an answer says what a plan key asks: a verdict on safety, a stop, or a steer with its passing side."""
    held = norm_plain(text)
    has = lambda *parts: F.rlike(held, F.concat(F.lit(r"\b"), *parts, F.lit(r"\b")))
    unsafe = has(F.lit("is unsafe"))
    verdict = F.when(safe.cast("boolean"), has(F.lit("is safe")) & ~unsafe).otherwise(unsafe)
    moving = has(F.lit("steer "), steer) & has(F.lit("continue forward")) & has(F.lit("passing to the "), pass_side, F.lit(" of object "), F.lower(blocker))
    return F.coalesce(F.when(kind == "candidate_maneuver_safety", verdict).when(steer == "stop", has(F.lit("should stop"))).otherwise(moving), F.lit(False))


# What introduces another entity, and words that no introduction has between itself and the entity.
INTRODUCTIONS = [
    "relationship with the surrounding environment:", "there is", "there are", "there was", "there were", "another", "with", "beside", "alongside", "near",
    "and a", "and an", "and the", "and another", "while a", "while an", "while the", "while another",
]
BREAKERS = ["is", "are", "was", "were", "to", "of", "on", "in", "from", "than", "behind", "front", "left", "right", "ahead", "near", "beside", "adjacent"]
MOST_FILL, MOST_CLAUSE = 7, 180


def introduced(clause: Column) -> Column:
    """Whether a clause ends in an introduction and up to MOST_FILL plain words.

    Its last words are counted while they are plain; after each of the first so
    many the rest is tried against the introductions.
    """
    held = F.regexp_replace(F.lower(clause), r"\s*:\s*", ": ")
    split = F.filter(F.split(held, r"\s+"), lambda w: w != "")

    def told(words: Column) -> Column:
        plain = F.transform(F.reverse(words), lambda w: F.rlike(w, F.lit("^[a-z0-9-]+$")) & ~w.isin(BREAKERS))
        first_odd = F.array_position(plain, F.lit(False))
        fill = F.least(F.lit(MOST_FILL), F.when(first_odd > 0, (first_odd - 1).cast("int")).otherwise(F.size(words)))
        head = lambda n: F.array_join(F.slice(words, F.lit(1), F.size(words) - n), " ")
        ends = lambda said: reduce(or_, [F.endswith(said, F.lit(i)) for i in INTRODUCTIONS])
        return F.exists(F.transform(F.sequence(F.lit(0), fill), head), ends)

    return bound(split, told)


def secondary_mentions(caption: Column, mentions: Column, main_end: Column) -> Column:
    """Of structs (start, end, word), those behind the main mention that their own clause introduces as another entity."""

    def clause(m: Column) -> Column:
        start = F.greatest(main_end, m["start"] - MOST_CLAUSE)
        return F.element_at(F.split(F.substr(caption, start + 1, m["start"] - start), "[.;!?]"), -1)

    return F.filter(mentions, lambda m: (m["start"] > main_end) & introduced(clause(m)))
