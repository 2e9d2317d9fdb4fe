"""Career taxonomy: a parameter, kept small enough to ship to every task.

A taxonomy is a list of domains, each with weighted terms, major (field of
study) words and typical roles, plus an undirected 'related' edge list. It is
passed to the operators as a value; ``from_frames`` reads it from tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from . import vocab

MAX_ENTRIES = 200_000


def norm_py(text: str) -> str:
    """The same normalisation as functions.text.norm, for driver-side words."""
    lowered = " ".join(str(text or "").split()).lower()
    return lowered.translate({ord(d): "-" for d in vocab.DASHES})


@dataclass(frozen=True)
class Domain:
    id: str
    name: str
    roles: tuple[str, ...] = ()
    majors: tuple[str, ...] = ()
    terms: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Entry:
    """One term of one domain; the position in the list is its number."""

    domain: int
    kind: str
    term: str
    weight: int


@dataclass(frozen=True)
class Taxonomy:
    domains: tuple[Domain, ...]
    edges: frozenset[tuple[str, str]] = field(default_factory=frozenset)

    def entries(self) -> list[Entry]:
        """Majors before terms inside each domain, domains in order."""
        out = []
        for number, domain in enumerate(self.domains):
            out += [Entry(number, "major", m, 0) for m in domain.majors]
            out += [Entry(number, "term", t, w) for t, w in domain.terms]
        if len(out) > MAX_ENTRIES:
            raise ValueError(f"taxonomy has {len(out)} entries, limit {MAX_ENTRIES}")
        return out

    def words(self) -> list[str]:
        """Distinct normalised words, in entry order: the search vocabulary."""
        return list(dict.fromkeys(norm_py(e.term) for e in self.entries()))

    def number(self, name_or_id: str) -> int:
        for i, d in enumerate(self.domains):
            if name_or_id in (d.id, d.name):
                return i
        return -1

    def related(self, a: str, b: str) -> bool:
        return a == b or (a, b) in self.edges or (b, a) in self.edges

    def strong_terms(self, number: int, limit: int | None = None) -> list[str]:
        """Majors, then terms of weight 5 and more, distinct."""
        d = self.domains[number]
        out = list(dict.fromkeys([*d.majors, *[t for t, w in d.terms if w >= 5]]))
        return out[:limit] if limit else out

    # -- the same facts as literal columns ---------------------------------
    def ids(self) -> Column:
        return F.lit([d.id for d in self.domains])

    def names(self) -> Column:
        return F.lit([d.name for d in self.domains])


def from_frames(domains: DataFrame, terms: DataFrame, edges: DataFrame | None = None) -> Taxonomy:
    """Read ``domain(ord,id,name,roles)``, ``term(domain_id,ord,kind,term,weight)``, ``edge(a,b)``.

    Sizes are checked before anything reaches the driver.
    """
    for name, part in (("domain", domains), ("term", terms), ("edge", edges)):
        if part is not None and part.limit(MAX_ENTRIES + 1).count() > MAX_ENTRIES:
            raise ValueError(f"{name} table exceeds {MAX_ENTRIES} rows; split the taxonomy")
    rows = [r.asDict() for r in terms.orderBy("domain_id", "ord").collect()]
    heads = domains.orderBy("ord").collect()
    pairs = edges.collect() if edges is not None else []
    return Taxonomy(
        tuple(
            Domain(
                d["id"], d["name"], tuple(d["roles"] or ()),
                tuple(r["term"] for r in rows if r["domain_id"] == d["id"] and r["kind"] == "major"),
                tuple((r["term"], int(r["weight"])) for r in rows if r["domain_id"] == d["id"] and r["kind"] == "term"),
            )
            for d in heads
        ),
        frozenset((e["a"], e["b"]) for e in pairs),
    )
