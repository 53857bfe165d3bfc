"""Fields that a model's answer holds: expressions over the answer's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = "```"
_FIELDS = "map<string,string>"
#: Fixed value: the key under which a payload names its project.
PROJECT = "项目"


def unfenced(content: Column) -> Column:
    """What stands in a fenced block: the first marked as JSON, else one that the text begins with."""
    whole = F.btrim(content, F.lit(" \t\n\x0b\f\r"))
    inside = lambda rest: F.btrim(F.substring_index(rest, _FENCE, 1), F.lit(" \t\n\x0b\f\r"))
    after = lambda mark: F.substring(whole, F.instr(whole, mark) + F.lit(len(mark)), F.length(whole))
    opened = whole.startswith(_FENCE) & (F.instr(F.substring(whole, 4, 1 << 30), _FENCE) > 0)
    return F.when(F.instr(whole, _FENCE + "json") > 0, inside(after(_FENCE + "json"))).when(opened, inside(after(_FENCE))).otherwise(whole)


def payloads(content: Column) -> Column:
    """array<map<string,string>> of an answer's objects: a list, the ``items`` of an object, or the
    object itself; null for anything else. Values that are no strings are their JSON text."""
    text = unfenced(content)
    as_list = lambda c: F.from_json(c, f"array<{_FIELDS}>")
    objects = lambda c: F.when(F.forall(as_list(c), lambda m: m.isNotNull()), as_list(c))
    items = F.get_json_object(text, "$.items")
    return F.when(text.startswith("["), objects(text)).when(text.startswith("{"), F.when(items.startswith("["), objects(items)).otherwise(F.array(F.from_json(text, _FIELDS))))


def project_id(c: Column) -> Column:
    """AB-001 of a value that is a project's id; null for others."""
    found = F.regexp_extract(F.upper(F.btrim(c)), r"^([A-Z]{2,10})[-_ ]?([0-9]{3,4})$", 0)
    return F.when(found != "", F.concat(F.regexp_extract(found, "^([A-Z]+)", 1), F.lit("-"), F.regexp_extract(found, "([0-9]+)$", 1)))


def payload_ids(found: Column) -> Column:
    """Project ids that payloads name, in order, each once."""
    return F.array_distinct(F.filter(F.transform(found, lambda m: project_id(F.element_at(m, PROJECT))), lambda x: x.isNotNull()))


def confirmed_ids(by_model: Column, by_text: Column) -> Column:
    """Ids that a model names, of those that stand in the text if any do."""
    return F.when(F.size(by_text) > 0, F.array_intersect(by_model, by_text)).otherwise(by_model)


def payload_of(found: Column, project: Column) -> Column:
    """The payload of a project: the one that names it, else the first, else an empty one; named."""
    named = F.filter(found, lambda m: project_id(F.element_at(m, PROJECT)) == project)
    first = F.coalesce(F.get(named, 0), F.get(found, 0), F.expr("cast(map() as map<string,string>)"))
    return F.map_concat(F.map_filter(first, lambda k, v: k != PROJECT), F.create_map(F.lit(PROJECT), project))


def typed(found: Column, fields: dict[str, str]) -> Column:
    """A payload as a struct of a schema's fields (name to type); what is missing or doesn't fit is null."""
    return F.struct(*(F.element_at(found, F.lit(name)).try_cast(kind).alias(name) for name, kind in fields.items()))
