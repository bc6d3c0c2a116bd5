"""Text spans, token masks, descriptions and prompts of annotation records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenova.functions.text import squeeze

# Words that end a description, and words that make one spatial.
PREFIX_STOP = [
    "a", "an", "the", "and", "or", "there", "is", "are", "was", "were", "to", "from", "at", "in", "on", "of", "by", "while", "that", "which",
    "driving", "walking", "standing", "moving", "facing", "traveling",
]
SPATIAL = (
    r"(?i)\b(left|right|front|behind|back|ahead|near|nearby|far|next|beside|adjacent|located|positioned|situated|"
    r"upper|lower|middle|center|above|below|north|south|east|west)\b"
)
FOLLOW_STOP = r"(?i)\b(left|right|front|behind|back|ahead|near|nearby|far|next|beside|adjacent|located|positioned|situated|above|below|north|south|east|west|view)\b"
PROMPT_LABELS = {
    "implicit_grounding_tokens_only": "\nObject {role} token: ",
    "natural_descriptions_plus_implicit_grounding_tokens": "\nGrounding token for the {description} in the {view}: ",
    "natural_descriptions_and_implicit_tokens": "\nGrounding token for the {description}: ",
}


def word_offsets(text: Column) -> Column:
    """The blank-separated words of a short text as structs (start, end, word), places from 0."""
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")

    def add(done: Column, word: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"] + 1, F.lit(0))
        return F.array_append(done, F.struct(start.alias("start"), (start + F.length(word)).alias("end"), word.alias("word")))

    return F.aggregate(F.split(text, " "), none, add)


def subword_offsets(text: Column, most: int = 3) -> Column:
    """Pieces of up to ``most`` letters or digits and single signs, as structs (start, end, word), places from 0."""
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")
    pieces = F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9]{{1,{most}}}|[^A-Za-z0-9\\s]"), F.lit(0))

    def add(done: Column, piece: Column) -> Column:
        past = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0))
        start = F.position(piece, text, past + 1) - 1
        found = F.struct(start.alias("start"), (start + F.length(piece)).alias("end"), piece.alias("word"))
        return F.array_append(done, found.cast("struct<start:int,end:int,word:string>"))

    return F.aggregate(pieces, none, add)


def target_span(caption: Column, name: Column) -> Column:
    """Struct (start, end) of a name in a blank-padded caption; null where it does not occur.

    A whole word counts first, then the head of a word, then any place, grown
    to the blanks about it. The first two start at the blank before the word.
    """
    size = F.length(name)
    word, head, place = (F.position(x, caption) for x in (F.concat(F.lit(" "), name, F.lit(" ")), F.concat(F.lit(" "), name), name))
    first_word = F.length(F.regexp_extract(F.substr(caption, head + 1), r"^\S+", 0))
    left = F.length(F.regexp_extract(F.substr(caption, F.lit(1), place - 1), "[^ ]*$", 0))
    right = F.length(F.regexp_extract(F.substr(caption, place + size), "^[^ ]*", 0))
    of = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    return F.when(word > 0, of(word - 1, word - 1 + size)).when(head > 0, of(head - 1, head - 1 + first_word)).when(place > 0, of(place - 1 - left, place - 1 + size + right))


def span_tokens(tokens: Column, start: Column, end: Column) -> Column:
    """Struct (first, last) of the tokens that a character span covers; an end that is in no token moves inwards by up to two."""

    def at(c: Column) -> Column:
        return F.array_min(F.transform(tokens, lambda t, i: F.when((t["start"] <= c) & (c < t["end"]), i)))

    first, last = F.coalesce(*[at(start + k) for k in range(3)]), F.coalesce(*[at(end - k) for k in (1, 2, 3)])
    return F.when(first.isNotNull() & last.isNotNull(), F.struct(first.alias("first"), last.alias("last")))


def token_mask(covered: Column, length: int, *, normalised: bool = True) -> Column:
    """Weights of ``length`` tokens: those of ``covered`` share 1 (or have 1 each), the others and no span at all give 0."""
    inside = lambda i: F.coalesce((i >= covered["first"]) & (i <= covered["last"]), F.lit(False))
    each = 1.0 / (covered["last"] - covered["first"] + 1) if normalised else F.lit(1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(inside(i), each).otherwise(0.0))


def safe_description(caption: Column, start: Column, end: Column, category: Column) -> Column:
    """What a caption says of the noun at a span, without places: up to five words before it and a with, wearing or in tail."""
    none = F.array().cast("array<string>")
    clause = F.regexp_extract(F.substr(caption, F.lit(1), start), r"[^.,;:?!]*$", 0)
    words = F.reverse(F.slice(F.reverse(F.regexp_extract_all(clause, F.lit("[A-Za-z0-9-]+"), F.lit(0))), 1, 5))
    ends = lambda w: F.lower(w).isin(PREFIX_STOP) | F.rlike(w, F.lit(SPATIAL))
    before = F.aggregate(words, none, lambda kept, w: F.when(ends(w), none).otherwise(F.array_append(kept, w)))
    tail = F.regexp_extract(F.substr(caption, end + 1), r"(?i)^\s+((?:with|wearing|in)\s+[^,.;?!]{1,70})", 1)
    tail = F.trim(F.regexp_replace(tail, r"(?is)\b(?:and|while)\b.*$", ""))
    tail = F.when((tail != "") & ~F.rlike(tail, F.lit(FOLLOW_STOP)), tail)
    told = F.concat_ws(" ", F.array_join(before, " "), F.substr(caption, start + 1, end - start), tail)
    told = F.regexp_replace(squeeze(told), r"^[ ,.;:]+|[ ,.;:]+$", "")
    unfit = (told == "") | F.rlike(told, F.lit(SPATIAL))
    return F.lower(F.when(unfit, F.replace(category, F.lit("othervehicle"), F.lit("special vehicle"))).otherwise(told))


def prompt_violation(question: Column, refs: Column, fields: list[str], policy: str) -> Column:
    """The first rule of a policy that a question's references break, else null. ``fields``: those the references have."""
    present = lambda *names: F.exists(refs, lambda o: sum((o[f].isNotNull().cast("int") for f in names if f in fields), F.lit(0)) > 0)
    lacks = lambda f: F.exists(refs, lambda o: F.coalesce(o[f] == "", F.lit(True))) if f in fields else F.size(refs) > 0
    hidden = F.when(present("category", "bbox", "center"), "geometry_in_refs")
    if policy == "implicit_grounding_tokens_only":
        return F.coalesce(hidden, F.when(present("description"), "description_in_refs"))
    wordless = F.when(lacks("description"), "no_description")
    if policy == "natural_descriptions_plus_implicit_grounding_tokens":
        return F.coalesce(hidden, wordless, F.when(lacks("view"), "no_view"))
    return F.coalesce(hidden, wordless, F.when(present("view"), "view_in_refs"), F.when(F.contains(F.lower(question), F.lit("view")), "view_in_question"))


def prompt(question: Column, refs: Column, policy: str, *, head: str = "", slot: str = "<token>", tail: str = "") -> Column:
    """The text of a prompt: question, then a label and a slot for the token of each reference."""
    parts = PROMPT_LABELS[policy].replace("}", "{").split("{")  # text and field names take turns

    def label(o: Column) -> Column:
        return F.concat(*[o[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)], F.lit(slot))

    return F.concat(F.lit(head), question, F.array_join(F.transform(refs, label), ""), F.lit(tail))
