"""Additive heuristics on names, signatures and bodies; vocabularies are parameters.

Each score comes with its signals, sorted vocabularies making the evidence deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .text import parameter_names, word_in

_EDGE = "(^|[^A-Za-z0-9_])"
_END = "($|[^A-Za-z0-9_])"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first_in(name: Column, words: Sequence[str]) -> Column:
    """The first word of the list that name contains."""
    return F.coalesce(*(F.when(name.contains(w), F.lit(w)) for w in words))


def _calls(words: Sequence[str]) -> str:
    return f"{_EDGE}({'|'.join(words)})\\s*\\("


def _total(signals: Sequence[tuple[str, int, Column]]) -> tuple[Column, Column]:
    score = F.lit(0)
    for _, weight, test in signals:
        score = score + F.when(F.coalesce(test, F.lit(False)), F.lit(weight)).otherwise(F.lit(0))
    return score.cast("int"), F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(label)) for label, _, test in signals)))


def _return_type(signature: Column) -> tuple[Column, Column]:
    """(whether a name stands before the first parenthesis, what precedes it, else all before the parenthesis)."""
    sig = _text(signature)
    named = F.rlike(sig, F.lit(r"^[^(]*[A-Za-z0-9_]\s*\("))
    before = F.substring_index(sig, "(", 1)
    return named, F.trim(F.when(named, F.regexp_replace(before, r"[A-Za-z0-9_]+\s*$", "")).otherwise(before))


def pointer_return(signature: Column) -> Column:
    return _text(signature).contains("(") & _return_type(signature)[1].contains("*")


def void_return(signature: Column) -> Column:
    """The return type is void; without a function name, the first of several words is."""
    named, before = _return_type(signature)
    return F.when(named, before == "void").otherwise(F.rlike(F.regexp_replace(before, r"\*", " "), F.lit(r"^\s*void\s+\S")))


def pointer_parameter(signature: Column) -> Column:
    return F.regexp_extract(_text(signature), r"\(([^)]*)\)", 1).contains("*")


def allocator(name: Column, signature: Column, source: Column, words=S.ALLOC_KEYWORDS, calls=S.KNOWN_ALLOC_CALLS, sizes=S.SIZE_PARAMS) -> tuple[Column, Column]:
    """(score, signals): name 3, pointer return 3, size parameter 2, calls one 2, returns one 2, null check 1."""
    body = _text(source)
    call = F.rlike(body, F.lit(_calls(calls)))
    sized = F.exists(parameter_names(signature), lambda p: F.lower(p).isin(*sizes)) | F.rlike(_text(signature), F.lit(f"{_EDGE}size_t{_END}"))
    null = F.rlike(body, F.lit(rf"(==|!=)\s*(NULL|0{_END})|!\s*[A-Za-z0-9_]+\s*\)"))
    return _total([
        ("name_keyword", 3, _first_in(F.lower(name), words).isNotNull()),
        ("pointer_return", 3, pointer_return(signature)),
        ("size_param", 2, sized),
        ("calls_allocator", 2, call),
        ("returns_alloc_result", 2, F.rlike(body, F.lit(rf"return\s+(\([^)]*\)\s*)?({'|'.join(calls)})\s*\("))),
        ("null_check", 1, call & null),
    ])


def deallocator(name: Column, signature: Column, source: Column, words=S.DEALLOC_KEYWORDS, calls=S.KNOWN_FREE_CALLS) -> tuple[Column, Column]:
    """(score, signals): name 3, void return 2, pointer parameter 2, calls one 2, frees a parameter 2."""
    body = _text(source)
    frees = F.exists(parameter_names(signature, True), lambda p: F.rlike(body, F.concat(F.lit(_calls(calls) + r"\s*\Q"), p, F.lit(rf"\E{_END}"))))
    return _total([
        ("name_keyword", 3, _first_in(F.lower(name), words).isNotNull()),
        ("void_return", 2, void_return(signature)),
        ("pointer_param", 2, pointer_parameter(signature)),
        ("calls_free", 2, F.rlike(body, F.lit(_calls(calls)))),
        ("frees_param", 2, frees),
    ])


_FIELD = r"[A-Za-z0-9_]+(?:->|\.)(?:[A-Za-z0-9_]+(?:->|\.))*[A-Za-z0-9_]+"
_LINKS = ("next", "prev", "left", "right", "child", "parent", "sibling", "flink", "blink")


def container(name: Column, signature: Column, source: Column, nouns=S.CONTAINER_NOUNS, verbs=S.CONTAINER_VERBS) -> tuple[Column, Column]:
    """(score, signals): eleven signals; comment lines don't count for those that look at lines."""
    body, sig, low = _text(source), _text(signature), F.lower(name)
    trimmed = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    code = F.filter(trimmed, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("/*"))
    some = lambda pattern: F.exists(code, lambda x: F.rlike(x, F.lit(pattern)))
    right = lambda x: F.regexp_replace(F.regexp_extract(x, rf"^{_FIELD}\s*=\s*(.+?)\s*;", 1), r"\([^)]*\)\s*", "")
    stored = F.exists(code, lambda x: F.exists(parameter_names(signature, True), lambda p: (right(x) != "") & word_in(p, right(x))))
    return _total([
        ("container_keyword", 3, _first_in(low, nouns).isNotNull()),
        ("action_keyword", 2, F.rlike(low, F.lit(rf"(^|_)({'|'.join(verbs)})(_|$)"))),
        ("void_ptr_param", 2, F.rlike(sig, F.lit(r"void\s*\*($|[^*])"))),
        ("void_ptr_return", 2, F.rlike(sig, F.lit(r"^\s*void\s*\*($|[^*])"))),
        ("void_dblptr_param", 2, F.rlike(sig, F.lit(r"void\s*\*\*"))),
        ("void_cast", 1, F.rlike(body, F.lit(r"\(\s*void\s*\*\s*\)"))),
        ("key_comparison", 1, F.rlike(body, F.lit(_calls(("strcmp", "memcmp", "strncmp", "wcscmp"))))),
        ("param_stored_to_field", 4, stored),
        ("return_struct_field", 1, some(rf"^return\s+{_FIELD}\s*;")),
        ("linked_ptr_manipulation", 3, some(rf"{_EDGE}[A-Za-z0-9_]+(->|\.)({'|'.join(_LINKS)}){_END}")),
        ("hash_computation", 2, some(rf"%\s*[A-Za-z0-9_]*(size|cap|len|count|num|buckets|slots){_END}|(?i){_EDGE}(hash|bucket)\s*[=(]")),
    ])


def container_type(raw: Column) -> Column:
    """Canonical type: exact, by synonym, by the first type (in alphabetical order) that it contains, else other."""
    t = F.regexp_replace(F.lower(F.trim(_text(raw))), "[- ]", "_")
    out = F.lit("other")
    for kind in reversed(S.CONTAINER_TYPES):
        out = F.when(t.contains(kind), F.lit(kind)).otherwise(out)
    for kind, names in S.CONTAINER_SYNONYMS.items():
        out = F.when(t.isin(*names), F.lit(kind)).otherwise(out)
    return F.when(t.isin(*S.CONTAINER_TYPES), t).otherwise(out)


def kinds_agree(run: Column, patch: Column) -> Column:
    """Whether a kind seen in a run can stand for the kind of a weakness number."""
    return F.coalesce(
        patch.isNull() | (run == patch) | (run == "segv")
        | ((patch == "integer_overflow") & run.isin("buffer_overflow", "integer_overflow"))
        | ((patch == "buffer_overflow") & (run == "integer_overflow")),
        F.lit(False),
    )


def kind_of(number: Column, kinds: dict[str, tuple]) -> Column:
    """The kind whose list has the value; null if none."""
    out = F.lit(None).cast("string")
    for kind, values in kinds.items():
        out = F.when(number.isin(*values), F.lit(kind)).otherwise(out)
    return out


def first_frame(frames: Column) -> Column:
    """The first stack frame of the program itself that has a file and a line, else the first frame."""
    file = lambda f: F.element_at(F.split(F.coalesce(f["file"], F.lit("")), "/"), -1)
    own = F.filter(frames, lambda f: F.coalesce(f["function"] != "", F.lit(False)) & ~f["function"].isin(*S.SKIPPED_FRAMES) & ~file(f).isin(*S.SKIPPED_FILES) & F.coalesce(f["file"] != "", F.lit(False)) & F.coalesce(f["line"] > 0, F.lit(False)))
    return F.coalesce(F.get(own, 0), F.get(frames, 0))
