"""Which memory records and artifacts a caller sees: temporal memory policy and access control, as column predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

STEERING_KINDS = ("alias", "preference", "exclusion")
MODES = ("auto", "off", "only", "prefer")


@dataclass(frozen=True)
class MemoryPolicy:
    mode: str = "auto"  # auto, off, only or prefer
    scopes: tuple[str, ...] = ()
    subject: str = ""
    current_only: bool = True
    as_of: str = ""
    include_rules: bool = False
    tiers: tuple[str, ...] = ()

    @classmethod
    def parse(cls, value: str | dict | MemoryPolicy | None) -> MemoryPolicy:
        """A policy from its mode alone, from a mapping, or as it is; what can't be read is the default."""
        if isinstance(value, MemoryPolicy):
            return value
        given = {"mode": value} if isinstance(value, str) else value if isinstance(value, dict) else {}
        mode = str(given.get("mode") or "auto").strip().lower()

        def several(name: str) -> tuple[str, ...]:
            own = given.get(name) or ()
            return (own,) if isinstance(own, str) else tuple(str(x) for x in own)

        return cls(
            mode=mode if mode in MODES else "auto", scopes=several("scopes"), subject=str(given.get("subject") or ""), current_only=bool(given.get("current_only", True)),
            as_of=str(given.get("as_of") or ""), include_rules=bool(given.get("include_rules", False)), tiers=several("tiers"),
        )

    def instant(self, now: str) -> str | None:
        return self.as_of or (now if self.current_only else None)

    def allowed_tiers(self) -> tuple[str, ...]:
        return self.tiers or (("hot", "cold") if self.as_of or not self.current_only else ("hot",))


def unset(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def admits(policy: MemoryPolicy, now: str) -> Column:
    """Whether a row passes; a row whose record_id is null isn't a memory record. Instants compare as text."""
    is_record = F.col("record_id").isNotNull()
    if policy.mode == "off":
        return ~is_record
    ok = F.coalesce(F.when(F.col("tier") == "", None).otherwise(F.col("tier")), F.lit("hot")).isin(*policy.allowed_tiers())
    if not policy.include_rules:
        ok &= ~F.coalesce(F.col("kind"), F.lit("")).isin(*STEERING_KINDS)
    if policy.scopes:
        ok &= F.coalesce(F.col("scope"), F.lit("")).isin(*policy.scopes)
    if policy.subject.strip():
        ok &= F.contains(F.lower(F.coalesce(F.col("subject"), F.lit(""))), F.lit(policy.subject.strip().lower()))
    at = policy.instant(now)
    if at is not None:
        ok &= unset("valid_from") | (F.col("valid_from") <= at)
        ok &= unset("valid_until") | (F.col("valid_until") > at)
    return is_record & ok if policy.mode == "only" else ~is_record | ok


def visible(identities: list[str] | None, default_public: bool, acl: str = "acl") -> Column:
    """Access by JSON list: {"public": true} or {"allow": [...]}. Text that isn't JSON fails closed."""
    parsed = F.from_json(acl, "public boolean, allow array<string>, _corrupt_record string", {"mode": "PERMISSIVE"})
    bad = parsed["_corrupt_record"].isNotNull()
    known = bool(identities)
    allowed = F.arrays_overlap(F.coalesce(parsed["allow"], F.array().cast("array<string>")), F.array(*[F.lit(i) for i in identities or ["\x00"]]))
    inside = F.coalesce(parsed["public"], F.lit(False)) | (F.lit(identities is not None) & F.coalesce(allowed, F.lit(False)))
    return F.when(unset(acl), F.lit(default_public or known)).when(bad, False).otherwise(inside)


def expand_principals(identities: list[str], groups: dict[str, list[str]], fresh: bool) -> list[str]:
    """Identities with their groups; groups of a stale directory count for none."""
    return sorted({*identities, *(g for i in identities if fresh for g in groups.get(i, []))})
