"""What each output column of a plan is made from, followed through every node by position.

Names prove nothing: an alias, a union, an exploded array, a subquery or a common table hands a
value on under another name. So the analysed plan is walked once and gives a graph over its
attributes: an edge for each attribute that another's value is made from. Nodes hand columns on by
position (unions, set operations, expansions, references to common tables), by expression (all that
project, aggregate or generate) or untouched. An output that no rule explains is taken to be made
from all that its node reads, so a kind of node that isn't known here hides too much, never too
little. What a column comes from is what can be reached from it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

#: Nodes whose output columns come from the columns in the same place of every child.
_BY_PLACE = frozenset({"Union", "Intersect", "Except", "UnionLoop"})
#: Expressions that say whether a value is there and nothing else of it.
_PRESENCE = frozenset({"IsNull", "IsNotNull"})


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(x) -> str:
    return x.getClass().getSimpleName()


class Provenance:
    """The sources of a DataFrame's columns, and those of the conditions that choose its rows."""

    def __init__(self, df: DataFrame):
        self.names: dict[int, set[str]] = {}
        self.made_from: dict[int, set[int]] = {}
        self.chosen_by: set[int] = set()
        self._shared: dict[int, list[int]] = {}  # outputs of common tables and recursions, by their id
        self._calls: list[tuple[int, list[int]]] = []  # references to them: id and own outputs
        self._subquery = df.sparkSession._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.SubqueryExpression")
        plan = df._jdf.queryExecution().analyzed()
        self.output = self._plan(plan, stored=False)
        for key, outputs in self._calls:
            for i, own in enumerate(outputs):
                self._from(own, self._shared[key][i : i + 1] if key in self._shared else [])

    def _from(self, made: int, sources: Iterable[int]) -> None:
        self.made_from.setdefault(made, set()).update(s for s in sources if s != made)

    def _attribute(self, a) -> int:
        i = a.exprId().id()
        self.names.setdefault(i, set()).add(a.name())
        return i

    def _refs(self, e, stored: bool, presence: bool = True) -> set[int]:
        """Attributes that an expression reads, those of its subqueries' results among them; presence: also where only their presence is asked."""
        kind = _kind(e)
        if kind == "AttributeReference":
            return {self._attribute(e)}
        if kind == "OuterReference":
            return self._refs(e.e(), stored, presence)
        if not presence and kind in _PRESENCE:
            return set()
        out: set[int] = set()
        if self._subquery.isInstance(e):
            out |= set(self._plan(e.plan(), stored))
        for c in _each(e.children()):
            out |= self._refs(c, stored, presence)
        if kind == "Alias":
            own = self._attribute(e)
            self._from(own, out)
            out = {own}
        return out

    def _plan(self, node, stored: bool) -> list[int]:
        """Walk a plan; its output. stored: inside a view, whose conditions are its maker's."""
        kind = _kind(node)
        if kind == "WithCTE":
            for d in _each(node.cteDefs()):
                self._shared[d.id()] = self._plan(d.child(), stored)
        inside = stored or kind == "View"
        children = [self._plan(c, inside) for c in _each(node.children())]
        read: set[int] = set()
        for e in _each(node.expressions()):
            read |= self._refs(e, stored)
        if kind in ("Filter", "Join", "LateralJoin", "Sort") and not stored:
            for e in _each(node.expressions()):
                if kind != "LateralJoin" or not self._subquery.isInstance(e):  # what a lateral subquery gives is no condition
                    self.chosen_by |= self._refs(e, stored, presence=False)
        if kind == "LateralJoin":
            children.append(self._plan(node.right().plan(), stored))
        output = [self._attribute(a) for a in _each(node.output())]
        below = {i for c in children for i in c}
        if kind in _BY_PLACE:
            for c in children:
                for own, i in zip(output, c):
                    self._from(own, [i])
            if kind == "UnionLoop":
                self._shared[node.id()] = output
        elif kind == "Expand":
            for row in _each(node.projections()):
                for own, e in zip(output, _each(row)):
                    self._from(own, self._refs(e, stored))
        elif kind in ("CTERelationRef", "UnionLoopRef"):
            self._calls.append((node.cteId() if kind == "CTERelationRef" else node.loopId(), output))
        elif children:
            for own in output:
                if own not in below and own not in self.made_from:
                    self._from(own, read | below if kind != "Generate" else read)
        return output

    def sources(self, attributes: Iterable[int]) -> set[str]:
        """Every name that these attributes, or what they are made from, bear on the way from storage."""
        seen, waiting = set(), list(attributes)
        while waiting:
            i = waiting.pop()
            if i not in seen:
                seen.add(i)
                waiting += self.made_from.get(i, ())
        return {n for i in seen for n in self.names.get(i, ())}

    def columns(self) -> list[set[str]]:
        """The sources of each output column, in order."""
        return [self.sources([i]) for i in self.output]

    def conditions(self) -> set[str]:
        """The sources of all conditions that choose, match or order rows; whether a value is there doesn't count as one."""
        return self.sources(self.chosen_by)
