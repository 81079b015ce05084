"""Profiles: the schema, policy, packs and routes of one family of documents, as one closed object with a digest."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import regex

from . import dates
from .canonical import canonical, digest
from .schema import PacketError, Policy, Schema

MEMBERS = {"profile", "id", "version", "description", "schema", "policy", "packs", "routes"}
ROUTE = {"field", "route", "status", "date", "bound", "documents"}
MOST_ROUTES, MOST_BYTES, DEEPEST = 10_000, 4 << 20, 32


def _depth(x: Any) -> int:
    if isinstance(x, Mapping):
        return 1 + max(map(_depth, x.values()), default=0)
    return 1 + max(map(_depth, x), default=0) if isinstance(x, (list, tuple)) else 0


@dataclass(frozen=True)
class Profile:
    id: str
    version: str
    schema: Schema
    policy: Policy
    routes: tuple[Mapping[str, Any], ...]
    raw: Mapping[str, Any]
    sha256: str

    @staticmethod
    def of(obj: Any) -> Profile:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise PacketError(f"the profile: {what}")

        need(isinstance(obj, Mapping) and set(obj) <= MEMBERS and obj.get("profile") == 1, "its format is unknown")
        need(_depth(obj) <= DEEPEST and len(canonical(dict(obj))) <= MOST_BYTES, "it is too deep or too large")
        need(isinstance(obj.get("id"), str) and bool(regex.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", obj["id"])), "its id")
        need(isinstance(obj.get("version"), str) and bool(regex.fullmatch(r"[0-9]+(?:\.[0-9]+){2}", obj["version"])), "its version")
        schema = Schema.of(obj.get("schema"), obj.get("packs", ()))
        policy = Policy.of(obj.get("policy"))
        routes = obj.get("routes", [])
        need(isinstance(routes, list) and len(routes) <= MOST_ROUTES, "its routes")
        seen = set()
        for r in routes:
            need(isinstance(r, Mapping) and set(r) <= ROUTE, "a route has other members")
            need(r.get("field") in schema.fields and isinstance(r.get("route"), str) and (r["field"], r["route"]) not in seen, "a route's field or name")
            need(r.get("status") in ("draft", "measured"), "a route's status")
            need(r.get("date") is None or dates.normal(r["date"]) is not None, "a route's date")
            need(r.get("bound") is None or isinstance(r["bound"], str) and bool(regex.fullmatch(r"(?:0(?:\.[0-9]{1,4})?|1)", r["bound"])), "a route's bound")
            need(r["status"] == "draft" or r.get("bound") is not None, "a measured route has a bound")
            seen.add((r["field"], r["route"]))
        return Profile(obj["id"], obj["version"], schema, policy, tuple(routes), obj, digest("profile", dict(obj)))

    def audit_rate(self, covered: int, least: int = 30) -> str:
        """The rate of blind audits: low once every route is measured and enough items are covered."""
        return "0.02" if self.routes and all(r["status"] == "measured" for r in self.routes) and covered >= least else "0.1"
