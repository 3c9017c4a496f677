"""Databases, retention policies, measurements, tombstones and continuous queries;
one JSON document under the engine's root."""

from __future__ import annotations

from .plans.literals import QueryError
from .sources.store import Folder, shard_length

MAX_FIELDS = 1024


class FieldConflict(QueryError):
    """A field was written with another kind before."""


def _policy(duration: int = 0, replication: int = 1, shard: int = 0, default: bool = False) -> dict:
    return {"duration": duration, "replication": replication, "shard": shard or shard_length(duration), "default": default}


class Catalog:
    def __init__(self, folder: Folder | None = None) -> None:
        self.folder = folder
        self.state: dict = (folder.read_json("catalog.json") if folder else None) or {"databases": {}, "batch": 0}

    def save(self) -> None:
        if self.folder:
            self.folder.write_json("catalog.json", self.state)

    def next_batch(self) -> int:
        self.state["batch"] += 1
        return self.state["batch"]

    # databases and retention policies

    def create_database(self, db: str, options: dict | None = None) -> dict:
        found = self.state["databases"].get(db)
        if found is None:
            options = dict(options or {})
            name = options.pop("name", "autogen")
            found = self.state["databases"][db] = {"policies": {name: _policy(**{**options, "default": True})}, "measurements": {}, "queries": {}}
        return found

    def database(self, db: str) -> dict:
        if db not in self.state["databases"]:
            raise QueryError(f"database not found: {db}")
        return self.state["databases"][db]

    def default_policy(self, db: str) -> str:
        return next((n for n, p in self.database(db)["policies"].items() if p["default"]), "autogen")

    def set_policy(self, db: str, name: str, options: dict, alter: bool = False) -> None:
        policies = self.database(db)["policies"]
        if alter and name not in policies:
            raise QueryError(f"retention policy not found: {name}")
        before = policies.get(name, {}) if alter else {}
        kept = {k: v for k, v in before.items() if k in ("duration", "replication", "default") or k == "shard" and "duration" not in options}
        policies[name] = _policy(**{**kept, **options})
        if options.get("default"):
            for n, p in policies.items():
                p["default"] = n == name

    # measurements: keyed by retention policy, then name

    def measurement(self, db: str, rp: str, name: str) -> dict | None:
        return self.database(db)["measurements"].get(rp, {}).get(name)

    def measurements(self, db: str) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for by_name in self.database(db)["measurements"].values():
            for name, m in by_name.items():
                out.setdefault(name, []).append(m)
        return out

    def register(self, db: str, rp: str, name: str, tags: set[str], kinds: dict[str, set[str]]) -> dict:
        """Adds tags and fields; a field with two kinds, here or in any policy of the
        database, is a conflict and nothing changes."""
        known: dict[str, str] = {}
        for m in self.measurements(db).get(name, []):
            known |= m["fields"]
        for f, seen in kinds.items():
            for kind in seen | ({known[f]} if f in known else set()):
                if known.setdefault(f, kind) != kind:
                    raise FieldConflict(f"field type conflict: {name}.{f} is {known[f]}, not {kind}")
        if len(known) > MAX_FIELDS:
            raise QueryError(f"{name} would have more than {MAX_FIELDS} fields")
        by_name = self.database(db)["measurements"].setdefault(rp, {})
        m = by_name.setdefault(name, {"tags": [], "fields": {}, "deleted": []})
        m["tags"] = sorted({*m["tags"], *tags})
        m["fields"] = {f: known[f] for f in sorted({*m["fields"], *kinds})}
        return m
