"""Settings from JSON, the rules and exact values they ask for, and small sets that grow: allow lists and known secrets."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tracelake.functions.rules import Rule, rules_for
from tracelake.operators import ledger

LEAST_VALUE = 8


def read(text: str | None, name: str = "settings") -> dict:
    """Settings from a JSON text; none are empty settings, and so are malformed ones, with a warning."""
    if text is None:
        return {}
    try:
        found = json.loads(text)
    except ValueError:
        found = None
    if not isinstance(found, dict):
        warnings.warn(f"{name} hold no JSON object and are left out", stacklevel=2)
        return {}
    return found


def merge(user: dict, repo: dict) -> dict:
    """Section by section, key by key, the repository's settings over the user's; allow lists are united."""
    out = dict(user)
    for section, value in repo.items():
        base = out.get(section)
        if not isinstance(base, dict) or not isinstance(value, dict):
            out[section] = value
            continue
        out[section] = base | value
        lists = [x["allowFingerprints"] for x in (base, value) if isinstance(x.get("allowFingerprints"), list)]
        if len(lists) == 2:
            out[section]["allowFingerprints"] = list(dict.fromkeys(lists[0] + lists[1]))
    return out


def capture_rules(settings: dict) -> list[Rule]:
    """The rules that capture redacts by: none if switched off, else the built-in ones and the sound ones of the user."""
    asked = settings.get("redact") or {}
    if asked.get("capture") is False:
        return []
    found = rules_for("capture")
    for i, p in enumerate(asked.get("patterns") or []):
        if not isinstance(p, dict) or not p.get("pattern"):
            continue
        try:
            re.compile(p["pattern"])
        except re.error:
            continue
        found.append(Rule(p.get("id") or f"user-pattern-{i}", "capture", p["pattern"]))
    return found


def dotenv(text: str) -> dict[str, str]:
    """Names and values of a file of NAME=value lines; comments and blank lines are left out, quotes around a value too."""
    out = {}
    for line in text.split("\n"):
        name, sign, value = line.strip().partition("=")
        value = value.strip()
        if not sign or name.startswith("#"):
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[name.strip()] = value
    return out


def secret_values(named: Mapping[str, str], public: str = r"(?i)^(?:path|home|pwd|shell|user|lang|term|tz)$|_(?:path|dir|home)$") -> list[str]:
    """Values to scrub exactly: long enough, no paths, and not under a name that is public."""
    return sorted({v for k, v in named.items() if len(v) >= LEAST_VALUE and not v.startswith("/") and not re.search(public, k)})


def remember(new: DataFrame, path: str) -> int:
    """Add the rows of a one-column table that the set at a path lacks; how many there were."""
    spark: SparkSession = new.sparkSession
    name = new.columns[0]
    fresh = new.where(f"{name} is not null").distinct()
    old = ledger.table(spark, path, new.schema)
    if old is not None:
        fresh = fresh.join(old, name, "left_anti")
    fresh = fresh.persist()
    count = fresh.count()
    if count:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return count
