"""Semantic queries compiled to one DataFrame plan.

A query names measures, dimensions, filters and time dimensions. Measures are grouped by the cube
that owns them; each such branch joins what its expressions, dimensions and filters need along
to-one edges of the join graph, aggregates once, and branches meet on the dimensions. So a measure
is never multiplied by another branch, and all of a branch's measures cost one aggregation.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.model import CUBES, MASKED, PRIVILEGED, VIEWS, Measure
from marlstone.plans.rollups import Rollups
from marlstone.sources.bindings import Catalog

_REF = re.compile(r"\$(?:(\w+)\.)?(\w+)")
_HAS_ONE = re.compile(r"\$(\w+) = \$\w+\.(\w+)(?: AND (.*))?$")
_OPERATORS = {
    "equals": lambda c, v: c.isin(v), "notEquals": lambda c, v: ~c.isin(v), "gt": lambda c, v: c > v[0], "gte": lambda c, v: c >= v[0], "lt": lambda c, v: c < v[0], "lte": lambda c, v: c <= v[0],
    "set": lambda c, v: c.isNotNull(), "notSet": lambda c, v: c.isNull(), "contains": lambda c, v: F.lower(c).contains(str(v[0]).lower()), "inDateRange": lambda c, v: (c >= v[0]) & (c < v[1]),
}


class AmbiguousPath(ValueError):
    pass


class AccessDenied(PermissionError):
    pass


def resolve_member(name: str) -> str:
    """A member of a view becomes the cube member behind it."""
    owner, _, member = name.partition(".")
    return VIEWS[owner][member] if owner in VIEWS else name


def filter_members(filters: Iterable[dict]) -> list[str]:
    out = []
    for f in filters:
        for k in ("and", "or"):
            out += filter_members(f.get(k, ()))
        if "member" in f:
            out.append(resolve_member(f["member"]))
    return out


def members(query: dict) -> list[str]:
    """Every cube member that a query touches, wherever it names it."""
    named = [*query.get("measures", ()), *query.get("dimensions", ()), *(t["dimension"] for t in query.get("timeDimensions", ()))]
    return [resolve_member(m) for m in named] + filter_members(query.get("filters", ()))


def authorise(query: dict, role: str | None) -> None:
    """Masked members are for nobody, risk members for the privileged role; views don't hide what they stand for."""
    asked = set(members(query))
    denied = sorted((asked & MASKED) | (set() if role == "privileged" else asked & PRIVILEGED))
    if denied:
        raise AccessDenied(f"not allowed for role {role or 'none'}: {', '.join(denied)}")


def path(start: str, goal: str, to_one: bool = True) -> list[tuple[str, str]]:
    """Shortest chain of joins between cubes; two equally short ones are an error."""
    edges: dict[str, list[str]] = {c: [] for c in CUBES}
    for c in CUBES.values():
        for j in c.joins:
            edges[c.name].append(j.to)
            if j.relationship == "has_one" or not to_one:
                edges[j.to].append(c.name)
    seen, queue, found = {start: 0}, deque([[start]]), []
    while queue:
        way = queue.popleft()
        if found and len(way) > len(found[0]):
            break
        if way[-1] == goal:
            found.append(way)
            continue
        for following in dict.fromkeys(edges[way[-1]]):
            if following not in way and seen.get(following, len(way)) >= len(way):
                seen[following] = len(way)
                queue.append([*way, following])
    if not found:
        if to_one:
            return path(start, goal, to_one=False)
        raise ValueError(f"no join path from {start} to {goal}")
    if len(found) > 1:
        raise AmbiguousPath(f"{start} to {goal}: {' > '.join(found[0])} or {' > '.join(found[1])}")
    return list(zip(found[0], found[0][1:]))


def _sql(text: str, cube: str) -> str:
    return _REF.sub(lambda m: f"`{m[1] or cube}__{m[2]}`", text)


def _refs(text: str, cube: str) -> set[tuple[str, str]]:
    return {(m[1] or cube, m[2]) for m in _REF.finditer(text)}


class SemanticLayer:
    """Queries over the cubes; with a folder of stored roll-ups, those that a roll-up covers are answered from it."""

    def __init__(self, catalog: Catalog, rollups: str | None = None):
        self.catalog, self.rollups = catalog, Rollups(rollups) if rollups else None

    def _table(self, cube: str, columns: set[str]) -> DataFrame:
        df = self.catalog.table(cube)
        return df.select(*[F.col(c).alias(f"{cube}__{c}") for c in df.columns if c in columns])

    def _joined(self, owner: str, needed: set[tuple[str, str]], shown: frozenset[str] = frozenset()) -> tuple[DataFrame, bool]:
        """The owner's rows with the needed columns of other cubes, and whether rows may repeat; then __row numbers the owner's.

        Rows on the far side of a to-many edge that are alike in the needed columns are joined once.
        If those columns are the edge's key and columns that tell the result's rows apart (shown),
        and no other to-many edge is walked, a row of the owner's meets each value once.
        """
        steps: list[tuple[str, str]] = []
        for goal in sorted({c for c, _ in needed} - {owner}):
            steps += [s for s in path(owner, goal) if s not in steps]
        columns: dict[str, set[str]] = {owner: {CUBES[owner].key}}
        for c, column in needed:
            columns.setdefault(c, set()).add(column)
        conditions, single, several, keys = {}, {}, set(), {}
        for a, b in steps:
            own = [(j, a) for j in CUBES[a].joins if j.to == b] or [(j, b) for j in CUBES[b].joins if j.to == a]
            join, holder = own[0]
            if holder == b and join.relationship == "belongs_to":
                several.add((a, b))
            conditions[(a, b)] = _sql(join.on, holder)
            if join.relationship == "has_one":
                m = _HAS_ONE.match(join.on)
                single[(a, b)] = (f"{b}__{m[2]}", _sql(m[3], holder) if m[3] else None) if holder == a else (f"{b}__{m[1]}", None)
            for c, column in _refs(join.on, holder):
                columns.setdefault(c, set()).add(column)
                keys.setdefault((a, b), set()).add((c, column))
            if not re.fullmatch(r"\S+ = \S+", join.on.strip()):
                keys.pop((a, b), None)  # only an equality says that rows that meet have one key
        apart = all(columns[b] <= {c for own, c in keys.get((a, b), ()) if own == b} | {c.split("__")[1] for c in shown if c.startswith(f"{b}__")} for a, b in several)
        many = bool(several) and not (len(several) == 1 and apart)
        df = self._table(owner, columns[owner])
        df = df.withColumn("__row", F.monotonically_increasing_id()) if many else df
        joined = {owner}
        for a, b in steps:
            if b not in joined:
                right = self._table(b, columns[b])
                right = right.distinct() if (a, b) in several else right
                df = df.join(self._one(right, *single[(a, b)]) if (a, b) in single else right, F.expr(conditions[(a, b)]), "left")
                joined.add(b)
        return df, many

    @staticmethod
    def _one(rows: DataFrame, key: str, where: str | None) -> DataFrame:
        """The rows that a has_one edge may meet, one for each key; a key with several fails the query, which would count its partner twice.

        The rows are grouped by the key that they are then joined by, so the check costs no shuffle
        of its own.
        """
        rows = rows.where(where) if where else rows
        rest = [c for c in rows.columns if c != key]
        table = key.split("__")[0]
        message = F.concat(F.lit(f"{table} has more than one row for "), F.lit(key.split("__")[1]), F.lit(" "), F.col(key).cast("string"))
        each = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest])
        return each.select(key, *[F.when(F.col("__n") == 1, F.col(c)).otherwise(F.raise_error(message)).alias(c) for c in rest])

    def _condition(self, f: dict) -> Column:
        for k, fold in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
            if k in f:
                return reduce(fold, [self._condition(x) for x in f[k]])
        cube, member = resolve_member(f["member"]).split(".")
        return _OPERATORS[f["operator"]](F.col(f"{cube}__{member}"), f.get("values", []))

    @staticmethod
    def _aggregate(m: Measure, cube: str) -> list[Column]:
        """Parts of a measure; sums are exact decimals, averages their sum and count."""
        keep = F.expr(_sql(m.where, cube)) if m.where else None
        if m.kind == "count":
            return [F.count_if(keep) if keep is not None else F.count(F.lit(1))]
        value = F.expr(_sql(m.sql, cube)).cast("decimal(18,4)")
        value = F.when(keep, value) if keep is not None else value
        return [F.sum(value)] if m.kind == "sum" else [F.sum(value), F.count(value)]

    @staticmethod
    def _finish(m: Measure, parts: list[Column], of) -> Column:
        if m.kind == "sum":
            return parts[0].cast("double")
        if m.kind == "avg":
            return parts[0].cast("double") / F.when(parts[1] != 0, parts[1])
        if m.kind == "number":
            return F.expr(re.sub(r"\[(\w+)\]", lambda x: f"cast(`{of(x[1])}` as double)", m.sql))
        return parts[0].cast("bigint")

    @staticmethod
    def closure(cube: str, names: Iterable[str]) -> list[str]:
        """Measures and those that they refer to, the latter first."""
        out: list[str] = []
        for n in names:
            for inner in [*SemanticLayer.closure(cube, re.findall(r"\[(\w+)\]", CUBES[cube].measures[n].sql)), n]:
                if inner not in out:
                    out.append(inner)
        return out

    def _branch(self, cube: str, names: list[str], dimensions: dict[str, Column], dimension_refs: set[tuple[str, str]], filters: list[dict], shown: Iterable[str] = ()) -> DataFrame:
        """shown: columns that are dimensions as they are."""
        wanted = self.closure(cube, names)
        base = [n for n in wanted if CUBES[cube].measures[n].kind != "number"]
        needed = set(dimension_refs) | {tuple(m.split(".")) for m in filter_members(filters)}
        for n in base:
            m = CUBES[cube].measures[n]
            needed |= _refs(m.sql, cube) | _refs(m.where, cube)
        df, many = self._joined(cube, needed, frozenset(shown))
        for f in filters:
            df = df.where(self._condition(f))
        df = df.withColumns(dimensions) if dimensions else df
        if many:  # a to-many edge was walked: each of the owner's rows counts once for each value of the dimensions
            df = df.dropDuplicates(["__row", *dimensions])
        parts = {n: self._aggregate(CUBES[cube].measures[n], cube) for n in base}
        df = df.groupBy(*dimensions).agg(*[p.alias(f"{n}__{i}") for n, ps in parts.items() for i, p in enumerate(ps)])
        for n in wanted:
            m = CUBES[cube].measures[n]
            df = df.withColumn(f"{cube}.{n}", self._finish(m, [F.col(f"{n}__{i}") for i in range(len(parts.get(n, ())))], lambda x: f"{cube}.{x}"))
        return df.select(*dimensions, *[F.col(f"`{cube}.{n}`").alias(f"{cube}__{n}__out") for n in names])

    def load(self, query: dict, role: str | None = None) -> DataFrame:
        """The rows of a query; columns bear the members' names with _ for the dot. A caller without a role isn't privileged.

        query: measures, dimensions, filters ({member, operator, values}, nested in and/or),
        timeDimensions ({dimension, granularity, dateRange}), order ([(member, 'asc'|'desc')]), limit.
        """
        authorise(query, role)
        stored = self._stored(query)
        if stored is not None:
            return self._ordered(self.load_from_rollup(query, stored), query)
        named = {m: resolve_member(m) for m in [*query.get("measures", ()), *query.get("dimensions", ()), *(t["dimension"] for t in query.get("timeDimensions", ()))]}
        out_name = {m: m.replace(".", "_") for m in named}
        dimensions: dict[str, Column] = {}
        refs: set[tuple[str, str]] = set()
        filters = list(query.get("filters", ()))
        for d in query.get("dimensions", ()):
            cube, member = named[d].split(".")
            dimensions[out_name[d]] = F.col(f"{cube}__{member}")
            refs.add((cube, member))
        for t in query.get("timeDimensions", ()):
            cube, member = named[t["dimension"]].split(".")
            if "granularity" in t:
                dimensions[f"{out_name[t['dimension']]}_{t['granularity']}"] = F.date_trunc(t["granularity"], F.col(f"{cube}__{member}")).cast("date")
                refs.add((cube, member))
            if "dateRange" in t:
                filters.append({"member": t["dimension"], "operator": "inDateRange", "values": [F.lit(v).cast("timestamp_ntz") for v in t["dateRange"]]})
        owners: dict[str, list[str]] = {}
        for m in query.get("measures", ()):
            cube, member = named[m].split(".")
            owners.setdefault(cube, []).append(member)
        if not owners:
            cube = next(iter(refs))[0]
            df, _ = self._joined(cube, refs | {tuple(m.split(".")) for m in filter_members(filters)})
            for f in filters:
                df = df.where(self._condition(f))
            result = df.select(*[c.alias(n) for n, c in dimensions.items()]).distinct()
        else:
            shown = ["{}__{}".format(*named[d].split(".")) for d in query.get("dimensions", ())]
            branches = [self._branch(cube, names, dimensions, refs, filters, shown) for cube, names in owners.items()]
            result = branches[0]
            for b in branches[1:]:
                result = self._meet(result, b, list(dimensions))
            result = result.select(*dimensions, *[F.col("{}__{}__out".format(*named[m].split("."))).alias(out_name[m]) for m in query["measures"]])
        return self._ordered(result, query)

    @staticmethod
    def _ordered(result: DataFrame, query: dict) -> DataFrame:
        order = [F.col(m.replace(".", "_")).desc_nulls_last() if way == "desc" else F.col(m.replace(".", "_")).asc_nulls_last() for m, way in query.get("order", ())]
        result = result.orderBy(*order) if order else result
        return result.limit(query["limit"]) if "limit" in query else result

    @staticmethod
    def _meet(a: DataFrame, b: DataFrame, dimensions: list[str]) -> DataFrame:
        if not dimensions:
            return a.crossJoin(b)  # one row each
        right = b.select(*[F.col(d).alias(f"{d}__r") for d in dimensions], *[c for c in b.columns if c not in dimensions])
        on = reduce(lambda x, y: x & y, [a[d].eqNullSafe(right[f"{d}__r"]) for d in dimensions])
        joined = a.join(right, on, "full")
        return joined.select(*[F.coalesce(a[d], right[f"{d}__r"]).alias(d) for d in dimensions], *[c for c in [*a.columns, *right.columns] if c not in dimensions and not c.endswith("__r")])

    # Roll-ups: stored aggregates that answer queries they cover.

    def rollup_tables(self, cube: str, name: str) -> list[str]:
        """The logical tables that a roll-up is made from."""
        _, needed = self._rollup_needs(cube, name)
        steps = [s for goal in sorted({c for c, _ in needed} - {cube}) for s in path(cube, goal)]
        return sorted({cube} | {c for s in steps for c in s})

    def _rollup_needs(self, cube: str, name: str) -> tuple[list[str], set[tuple[str, str]]]:
        measures, dimensions = CUBES[cube].rollups[name]
        base = [n for n in self.closure(cube, measures) if CUBES[cube].measures[n].kind != "number"]
        needed = {tuple(d.split(".")) for d in dimensions}
        for n in base:
            m = CUBES[cube].measures[n]
            needed |= _refs(m.sql, cube) | _refs(m.where, cube)
        return base, needed

    def partials(self, cube: str, name: str, only: tuple[str, DataFrame] | None = None) -> DataFrame:
        """A roll-up's states: its dimensions, __rows, and what adds up of each measure: counts, sums and (__n) how many values a sum has.

        only: a column of the cube and its values, if no other rows are asked for.
        """
        base, needed = self._rollup_needs(cube, name)
        df, many = self._joined(cube, needed | ({(cube, only[0])} if only else set()))
        if many:
            raise ValueError(f"{cube}.{name} walks a to-many edge: its states don't add up")
        if only:
            df = df.join(only[1].withColumnRenamed(only[0], f"{cube}__{only[0]}"), f"{cube}__{only[0]}", "left_semi")
        states = [F.count(F.lit(1)).alias("__rows")]
        for n in base:
            m = CUBES[cube].measures[n]
            parts = self._aggregate(m, cube)
            if m.kind == "count":
                states.append(parts[0].cast("bigint").alias(f"{cube}_{n}"))
            else:
                count = self._aggregate(Measure("avg", m.sql, m.where), cube)[1]
                states += [parts[0].cast("decimal(38,4)").alias(f"{cube}_{n}"), count.alias(f"{cube}_{n}__n")]
        return df.groupBy(*[F.col(d.replace(".", "__")).alias(d.replace(".", "_")) for d in CUBES[cube].rollups[name][1]]).agg(*states)

    def materialise(self, cube: str, name: str) -> None:
        """Store a roll-up, or store it anew."""
        self.rollups.store(self.catalog, cube, name)

    def _stored(self, query: dict) -> DataFrame | None:
        """The stored roll-up that covers a query, if there is one that is up to date and that the catalog's role may read."""
        found = self.matching_rollup(query) if self.rollups else None
        return self.rollups.read(self.catalog, *found) if found else None

    @staticmethod
    def matching_rollup(query: dict) -> tuple[str, str] | None:
        """A roll-up whose measures and dimensions cover the query; only counts and sums add up."""
        measures = {resolve_member(m) for m in query.get("measures", ())}
        wanted = {resolve_member(d) for d in query.get("dimensions", ())} | set(filter_members(query.get("filters", ())))
        for c in CUBES.values():
            for name, (held, dimensions) in c.rollups.items():
                if not query.get("timeDimensions") and measures and measures <= {f"{c.name}.{m}" for m in held if c.measures[m].kind in ("count", "sum")} and wanted <= set(dimensions):
                    return c.name, name
        return None

    def load_from_rollup(self, query: dict, stored: DataFrame) -> DataFrame:
        """A covered query, answered by adding up the stored rows."""
        df = stored
        for f in query.get("filters", ()):
            df = df.where(self._rollup_condition(f))
        sums = []
        for m in query["measures"]:
            cube, member = resolve_member(m).split(".")
            held = F.col(f"{cube}_{member}")
            total = F.coalesce(F.sum(held), F.lit(0)).cast("bigint") if CUBES[cube].measures[member].kind == "count" else F.sum(held).cast("double")
            sums.append(total.alias(m.replace(".", "_")))
        return df.groupBy(*[F.col(resolve_member(d).replace(".", "_")).alias(d.replace(".", "_")) for d in query.get("dimensions", ())]).agg(*sums)

    def _rollup_condition(self, f: dict) -> Column:
        for k, fold in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
            if k in f:
                return reduce(fold, [self._rollup_condition(x) for x in f[k]])
        return _OPERATORS[f["operator"]](F.col(resolve_member(f["member"]).replace(".", "_")), f.get("values", []))
