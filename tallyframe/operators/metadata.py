"""Resolving a model's metadata from its sources by rules.

A model comes with up to seven sources: a model card's front matter, the
config, the directory name, a generation config, an override document, a name
given by hand and a remote id. Each key has an ordered list of card aliases;
what the card leaves open the name heuristics fill, from the config's own name
and then from the directory; the generation config brings the sampling keys;
override, given name and remote id replace what is there. List keys append
their card aliases. The rules are tables: every member that one names becomes a
candidate (key, rank, value), and the lowest rank of a key wins. All of this
happens within the model's row, so a table of models resolves without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.naming import parse_artifact_name, source_refs
from tallyframe.functions.util import let
from tallyframe.operators.catalog import title_case_id

# Card aliases of every scalar key, the first that holds a value wins.
CARD_ALIASES = {
    "name": ("name", "model_name"),
    "author": ("author", "model_author", "model_creator"),
    "version": ("version", "model_version"),
    "organization": ("organization", "model_organization"),
    "description": ("description", "model_description"),
    "finetune": ("finetune", "model_finetune"),
    "basename": ("basename", "model_basename", "model_type"),
    "size_label": ("size_label", "model_size_label"),
    "source_url": ("url", "model_url"),
    "source_doi": ("doi", "model_doi"),
    "source_uuid": ("uuid", "model_uuid"),
    "source_repo_url": ("repo_url", "model_repo_url"),
    "license": ("license",),
    "license_name": ("license_name",),
    "license_link": ("license_link",),
}
# Card keys whose entries are appended, in order.
CARD_LISTS = {"tags": ("tags", "pipeline_tag"), "languages": ("languages", "language")}
# Card keys of source lists, the first that is present counts.
CARD_REFS = {"base_models": ("base_model", "base_models", "base_model_sources"), "datasets": ("datasets", "dataset", "dataset_sources")}
# Sampling keys and their names in a generation config.
SAMPLING = {
    "sequence": "sequence", "top_k": "top_k", "top_p": "top_p", "min_p": "min_p", "xtc_probability": "xtc_probability",
    "xtc_threshold": "xtc_threshold", "temp": "temperature", "penalty_last_n": "penalty_last_n", "penalty_repeat": "penalty_repeat",
    "mirostat": "mirostat", "mirostat_tau": "mirostat_tau", "mirostat_eta": "mirostat_eta",
}
# Keys that the name heuristics fill, and the part of a parsed name that fills them.
FROM_NAME = {"name": "full_name", "organization": "org", "basename": "basename", "finetune": "finetune", "version": "version", "size_label": "size_label"}
# Names of keys in an override document.
OVERRIDES = {
    **{k: f"general.{k}" for k in ("name", "author", "version", "organization", "finetune", "basename", "description", "quantized_by", "size_label",
                                   "url", "doi", "uuid", "repo_url", "base_models", "datasets", "tags", "languages")},
    "license_name": "general.license.name", "license_link": "general.license.link",
    "source_url": "general.source.url", "source_doi": "general.source.doi", "source_uuid": "general.source.uuid", "source_repo_url": "general.source.repo_url",
    **{f"sampling_{k}": f"general.sampling.{k}" for k in SAMPLING},
}
TITLED = ("name", "organization")


#: Order of the candidates for a key: a lower one goes first.
REMOTE, GIVEN, OVERRIDE, GENERATION, CARD, PARAMS, DIRECTORY = range(0, 700, 100)


def _object(doc: Column) -> Column:
    """Members of a JSON object; none for anything else."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(doc), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _text(v: Column) -> Column:
    """A member as text: strings as they are, other values as JSON, JSON null as null."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind != "VOID", F.to_json(v))


def _entries(v: Column) -> Column:
    """Entries of a list key: a string is one, a list its own, another value none; absent or null is null."""
    kind = F.schema_of_variant(v)
    return (F.when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string")))
            .when(kind.startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), _text))
            .when(kind != "VOID", F.array().cast("array<string>")))


def _candidate(key: Column | str, rank: Column | int, value: Column, source: str) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), (F.lit(rank) if isinstance(rank, int) else rank).alias("rank"),
                    value.alias("value"), F.lit(source).alias("source"))


def _by_rule(members: str, rules: dict[str, tuple[str, int]], source: str, nulls: bool = False) -> Column:
    """Candidates for the members that ``rules`` (member -> key, rank) names."""
    names = F.create_map(*[F.lit(x) for name, (key, _) in rules.items() for x in (name, key)])
    ranks = F.create_map(*[F.lit(x) for name, (_, rank) in rules.items() for x in (name, rank)])
    known = F.filter(F.map_entries(F.col(members)), lambda e: e["key"].isin(*rules))
    if not nulls:
        known = F.filter(known, lambda e: F.schema_of_variant(e["value"]) != "VOID")
    return F.transform(known, lambda e: _candidate(names[e["key"]], ranks[e["key"]], _text(e["value"]), source))


def _first_of_key(candidates: Column) -> Column:
    """The candidate of the lowest rank of every key."""
    return let(F.array_sort(candidates), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["key"] != x["key"])))


def resolve_metadata(models: DataFrame, entity: str, card: str | None = None, params: str | None = None, directory: str | None = None,
                     generation: str | None = None, override: str | None = None, given_name: str | None = None,
                     remote_id: str | None = None, total_params: str | None = None, size_label: str | None = None) -> DataFrame:
    """``(entity, key, value, source)``, one row per key that has a value.

    The arguments name columns: ``card``, ``params``, ``generation`` and
    ``override`` are JSON documents (anything but an object counts as empty),
    ``directory`` a path. Values are text: strings as they are, lists and other
    values as JSON. ``source`` tells where the value is from.

    Per key: the remote id, then the given name (both for ``name`` only); then
    the override, whose null takes a value away; then the generation config for
    sampling keys; then the card, the config's ``_name_or_path`` (if it is no
    path: at most one slash) and the directory's last part by the name
    heuristics (P11), titled (P12) for name and organization. A model that
    still has no name gets its directory's as it is, and one without a size
    label ``size_label`` (from A6) where ``total_params`` is positive. A
    repeated entity resolves row by row.
    """
    def col(name: str | None, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name else F.lit(None).cast(kind)

    folder = F.regexp_extract(F.rtrim(col(directory), F.lit("/")), r"([^/]*)$", 1)
    d = models.select(F.col(entity), F.coalesce(col(total_params, "bigint"), F.lit(0)).alias("__total"), F.when(folder != "", folder).alias("__folder"),
                      col(given_name).alias("__given"), col(remote_id).alias("__remote"), col(size_label).alias("__label"),
                      *[_object(col(c)).alias(f"__{n}") for n, c in (("card", card), ("params", params), ("generation", generation), ("override", override))])

    def member(members: str, key: str) -> Column:
        return F.try_element_at(F.col(members), F.lit(key))

    own = F.when(F.schema_of_variant(member("__params", "_name_or_path")) == "STRING", _text(member("__params", "_name_or_path")))
    own = let(own, lambda x: F.when(F.char_length(x) - F.char_length(F.replace(x, F.lit("/"), F.lit(""))) <= 1, x))
    total = F.col("__total")
    d = d.withColumn("__names", F.transform(F.array(own, F.col("__folder")), lambda x: parse_artifact_name(x, total)))

    def titled(c: Column) -> Column:
        return F.struct(title_case_id(c["full_name"]).alias("name"), title_case_id(c["org"]).alias("organization"),
                        *[c[part].alias(key) for key, part in FROM_NAME.items() if key not in TITLED])

    d = d.withColumn("__names", F.transform("__names", titled))

    def present(names: tuple[str, ...]) -> Column:
        out = F.lit(None).cast("variant")
        for n in reversed(names):
            out = F.when(F.map_contains_key(F.col("__card"), n), member("__card", n)).otherwise(out)
        return out

    d = d.withColumn("__refs", F.transform(F.array(*[present(names) for names in CARD_REFS.values()]), lambda v: F.to_json(source_refs(v, total))))
    for key, names in CARD_LISTS.items():
        lists = F.array_compact(F.array(*[_entries(member("__card", n)) for n in names]))
        d = d.withColumn(f"__{key}", let(lists, lambda a: F.when(F.size(a) > 0, F.to_json(F.flatten(a)))))

    some = [_candidate(key, CARD, F.col(f"__{key}"), "card") for key in CARD_LISTS]
    some += [_candidate(key, CARD, F.get(F.col("__refs"), F.lit(i)), "card") for i, key in enumerate(CARD_REFS)]
    for i, (source, rank) in enumerate((("params", PARAMS), ("directory", DIRECTORY))):
        some += [_candidate(key, rank, F.get(F.col("__names"), F.lit(i))[key], source) for key in FROM_NAME]
    some += [_candidate("name", GIVEN, F.col("__given"), "given"), _candidate("name", REMOTE, F.col("__remote"), "remote")]
    aliases = {}
    for key, names in CARD_ALIASES.items():
        aliases |= {name: (key, CARD + i) for i, name in enumerate(names)}
    cands = F.concat(
        F.filter(F.array(*some), lambda c: c["value"].isNotNull()), _by_rule("__card", aliases, "card"),
        _by_rule("__generation", {name: (f"sampling_{key}", GENERATION) for key, name in SAMPLING.items()}, "generation"),
        _by_rule("__override", {name: (key, OVERRIDE) for key, name in OVERRIDES.items()}, "override", nulls=True))
    d = d.withColumn("__found", F.filter(_first_of_key(cands), lambda c: c["value"].isNotNull()))
    last = F.array(_candidate("name", 1000, F.col("__folder"), "directory"), _candidate("size_label", 1000, F.when(total > 0, F.col("__label")), "computed"))
    d = d.withColumn("__found", _first_of_key(F.concat("__found", F.filter(last, lambda c: c["value"].isNotNull()))))
    # a plain explode would be preceded by a filter on the size of its array, and so by all of the above once more
    found = d.select(F.col(entity), F.explode_outer("__found").alias("__r")).where("__r is not null")
    return found.select(entity, "__r.key", "__r.value", "__r.source")
