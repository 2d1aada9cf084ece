"""Rules from files, to add to the catalogue or to take its place.

A file is YAML or JSON and holds a mapping ``entities`` of names to what is known of each; all but the data class may
be missing:

    entities:
      badge_number:
        regex_patterns: {accepted_patterns: ['\\bB-\\d{4}\\b', {pattern: '\\b\\d{4}\\b', confidence_weight: 0.2}], prohibited_patterns: [], confidence_weight: 0.6}
        validators: {enum: LUHN_CHECKSUM, confidence_weight: 0.9, primary: false}
        contextual_phrases: {values: [badge], confidence_weight: 0.5, window_before_chars: 50, window_after_chars: 25, rescue_override: false}
        prohibited_prefix: {values: [order]}
        prohibited_suffix: {values: []}
        affixes: {prefix: [], suffix: []}
        classification: {category: PII, data_class: direct_identifier, ner_confidence_weight: 0.65}
        de_identifier: ID_NUM
        default_action: DEFAULT
        is_a: pii::unique_identifier
        part_of: null

The part of an entity's id before ``::`` is the file's name up to its first underscore, or ``ontology``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

from .rules import Rule, catalogue, check


def _parsed(path: str):
    with open(path, encoding="utf-8") as f:
        body = f.read()
    if path.lower().endswith(".json"):
        return json.loads(body)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path}: to read YAML, the library yaml must be installed; JSON needs none") from e
    return yaml.safe_load(body)


def _number(x, kind=float):
    try:
        return None if x is None or isinstance(x, bool) else kind(x)
    except (TypeError, ValueError):
        return None


def _strings(section: dict, key: str = "values") -> tuple[str, ...]:
    return tuple(s for x in (section or {}).get(key) or [] if isinstance(x, str) and (s := x.strip()))


def _id(x, ontology: str) -> str | None:
    """An entity's id, whose first part may be a file's whole name."""
    if not isinstance(x, str) or not x.strip():
        return None
    head, sep, name = x.strip().rpartition("::")
    return f"{head.split('_')[0] if sep else ontology}::{name}"


def _rule(name: str, raw: dict, ontology: str) -> Rule:
    section = lambda k: raw.get(k) if isinstance(raw.get(k), dict) else {}
    found, shown, told, kind = section("regex_patterns"), section("contextual_phrases"), section("validators"), section("classification")
    patterns, weights = [], []
    for p in found.get("accepted_patterns") or []:
        text, weight = (p, None) if isinstance(p, str) else (p.get("pattern"), p.get("confidence_weight")) if isinstance(p, dict) else (None, None)
        if isinstance(text, str) and text.strip():
            patterns.append(text.strip())
            weights.append(_number(weight))
    validator = told.get("enum")
    for p in (*patterns, *_strings(found, "prohibited_patterns")):
        try:
            re.compile(p)
        except re.error as e:
            raise ValueError(f"{ontology}::{name}: {p} is no pattern: {e}") from e
    phrase_weight, ner = _number(shown.get("confidence_weight")), _number(kind.get("ner_confidence_weight"))
    return Rule(
        f"{ontology}::{name}",
        kind.get("data_class") or "neutral",
        raw.get("de_identifier") or None,
        tuple(patterns),
        _number(found.get("confidence_weight")),
        re.sub("^VALIDATE_", "", validator.strip()) if isinstance(validator, str) and validator.strip() else None,
        _number(told.get("confidence_weight")),
        told.get("primary") is True,
        _strings(shown),
        phrase_weight,
        _id(raw.get("is_a"), ontology),
        _id(raw.get("part_of"), ontology),
        tuple(x.lower() for x in _strings(section("prohibited_prefix"))),
        tuple(x.lower() for x in _strings(section("prohibited_suffix"))),
        _strings(found, "prohibited_patterns"),
        _strings(section("affixes"), "prefix"),
        _strings(section("affixes"), "suffix"),
        shown.get("rescue_override") is True,
        0.65 if ner is None else ner,
        _number(shown.get("window_before_chars"), int) or 50,
        _number(shown.get("window_after_chars"), int) or 25,
        None,
        (raw.get("default_action") or "DEFAULT").strip(),
        tuple(weights) if any(w is not None for w in weights) else (),
        raw.get("description"),
    )


def read(path: str, ontology: str | None = None) -> tuple[Rule, ...]:
    """The rules of one file, in its order; a class, validator, action or pattern that can't be is an error that names the entity."""
    data = _parsed(path) or {}
    entities = data.get("entities") if isinstance(data, dict) else None
    if not isinstance(entities, dict):
        raise ValueError(f"{path}: a mapping 'entities' is missing")
    ontology = ontology or os.path.basename(path).split(".")[0].split("_")[0]
    return tuple(check([_rule(str(k), v, ontology) for k, v in entities.items() if isinstance(v, dict)]))


def load(paths: Iterable[str] | None = None, extend: bool = False) -> tuple[Rule, ...]:
    """The rules of the files, later ones in place of earlier ones with the same id; None: the catalogue; extend: after it."""
    if paths is None:
        return catalogue()
    out = {r.entity_id: r for r in catalogue()} if extend else {}
    for p in paths:
        out |= {r.entity_id: r for r in read(p)}
    return tuple(check(list(out.values())))


def labels(path: str) -> dict[str, tuple[str, ...]]:
    """Entities by a tagger's labels, from a mapping ``mappings`` of each label to an id or a list of them."""
    raw = (_parsed(path) or {}).get("mappings") or {}
    out = {str(k).strip(): tuple(e for x in (v if isinstance(v, list) else [v]) if (e := _id(x, "pii"))) for k, v in raw.items()}
    return {k: v for k, v in out.items() if k and v}
