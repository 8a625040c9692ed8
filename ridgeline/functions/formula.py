"""Formulas: one syntax tree for prefix calls and infix text, compiled to expressions that Catalyst optimises.

Two dialects give operators their meaning at the borders of their domains. ``protected`` (prefix programs): division by
at most 0.001 in size is 1, square roots and logarithms take absolute values, a logarithm of at most 0.001 is 0, so is
the inverse. ``plain`` (infix): null outside the domain.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARITY = {"add": 2, "sub": 2, "mul": 2, "div": 2, "max": 2, "min": 2, "sqrt": 1, "log": 1, "abs": 1, "neg": 1, "inv": 1, "square": 1}
_SIGNS = {"+": "add", "-": "sub", "*": "mul", "/": "div"}
_SHOWN = {name: sign for sign, name in _SIGNS.items()}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|([-+*/(),]))")
TINY = 0.001


class Node(NamedTuple):
    """``op`` is a function name, ``col`` or ``const``; ``value`` the column's name or the number."""

    op: str
    args: tuple = ()
    value: object = None

    @property
    def size(self) -> int:
        return 1 + sum(a.size for a in self.args)


def parse(text: str) -> Node:
    """Either syntax, or a mix: calls of known functions, names, numbers, and the four operators with their precedence."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        tokens.append(m.groups())
        at = m.end()
    tokens.append((None, None, None))
    k = 0

    def sign():
        return tokens[k][2]

    def need(what):
        nonlocal k
        if sign() != what:
            raise ValueError(f"{what!r} is missing in {text!r}")
        k += 1

    def level(signs, below):
        nonlocal k
        node = below()
        while sign() is not None and sign() in signs:
            op = _SIGNS[sign()]
            k += 1
            node = Node(op, (node, below()))
        return node

    def atom():
        nonlocal k
        number, name, mark = tokens[k]
        k += 1
        if number is not None:
            return Node("const", value=float(number))
        if mark == "-":
            inner = atom()
            return Node("const", value=-inner.value) if inner.op == "const" else Node("neg", (inner,))
        if mark == "+":
            return atom()
        if mark == "(":
            inner = whole()
            need(")")
            return inner
        if name is None:
            raise ValueError(f"unexpected end or sign in {text!r}")
        if sign() != "(":
            return Node("col", value=name)
        k += 1
        args = [whole()]
        while sign() == ",":
            k += 1
            args.append(whole())
        need(")")
        if ARITY.get(name) != len(args):
            raise ValueError(f"{name} doesn't take {len(args)} arguments")
        return Node(name, tuple(args))

    def product():
        return level("*/", atom)

    def whole():
        return level("+-", product)

    node = whole()
    if tokens[k] != (None, None, None):
        raise ValueError(f"left over in {text!r}")
    return node


def show(node: Node, infix: bool = False) -> str:
    if node.op == "col":
        return node.value
    if node.op == "const":
        return repr(node.value)
    args = [show(a, infix) for a in node.args]
    return f"({args[0]} {_SHOWN[node.op]} {args[1]})" if infix and node.op in _SHOWN else f"{node.op}({', '.join(args)})"


def to_json(node: Node) -> str:
    def plain(n):
        return {"op": n.op} | ({"args": [plain(a) for a in n.args]} if n.args else {"value": n.value})

    return json.dumps(plain(node))


def from_json(text: str) -> Node:
    def node(x):
        return Node(x["op"], tuple(node(a) for a in x.get("args", ())), x.get("value"))

    return node(json.loads(text))


def columns_of(node: Node) -> set[str]:
    return {node.value} if node.op == "col" else set().union(*(columns_of(a) for a in node.args))


def canonical(node: Node) -> Node:
    """Arguments of symmetric operators in one order, double negation gone: for finding equal formulas."""
    args = tuple(canonical(a) for a in node.args)
    if node.op in ("add", "mul", "max", "min"):
        args = tuple(sorted(args, key=show))
    if node.op == "neg" and args[0].op == "neg":
        return args[0].args[0]
    return Node(node.op, args, node.value)


def canonical_text(node: Node) -> str:
    """``show(canonical(node))``, without the node."""
    if not node.args:
        return show(node)
    args = [canonical_text(a) for a in node.args]
    if node.op in ("add", "mul", "max", "min"):
        args.sort()
    if node.op == "neg" and args[0].startswith("neg("):
        return args[0][4:-1]
    return f"{node.op}({', '.join(args)})"


def _safe(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def compile_node(node: Node, dialect: str = "plain", made_already: dict[Node, str] | None = None) -> Column:
    """The expression of a formula over columns of doubles. ``made_already`` names the columns that hold sub-formulas."""
    if made_already and node in made_already:
        return F.col(made_already[node])
    if node.op == "col":
        return F.col(node.value).cast("double")
    if node.op == "const":
        return F.lit(float(node.value))
    x, *rest = (compile_node(a, dialect, made_already) for a in node.args)
    y = rest[0] if rest else None
    guarded = dialect == "protected"
    made = {
        "add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "neg": lambda: -x, "abs": lambda: F.abs(x), "square": lambda: x * x,
        "max": lambda: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)), "min": lambda: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)),
        "div": lambda: F.when(F.abs(y) > TINY, F.try_divide(x, y)).when(x.isNotNull() & y.isNotNull(), 1.0) if guarded else F.try_divide(x, y),
        "sqrt": lambda: F.sqrt(F.abs(x)) if guarded else F.when(x >= 0, F.sqrt(x)),
        "log": lambda: F.when(F.abs(x) > TINY, F.log(F.abs(x))).when(x.isNotNull(), 0.0) if guarded else F.when(x > 0, F.log(x)),
        "inv": lambda: F.when(F.abs(x) > TINY, F.try_divide(F.lit(1.0), x)).when(x.isNotNull(), 0.0) if guarded else F.try_divide(F.lit(1.0), x),
    }
    return made[node.op]()


def shared_parts(nodes: list[Node]) -> list[list[Node]]:
    """Sub-formulas that stand in two places or more of the graph that ``nodes`` make when equal sub-formulas are one node,
    in layers: what a layer needs is in those before it."""
    uses: dict[Node, int] = {}

    def walk(node: Node) -> None:
        uses[node] = uses.get(node, 0) + 1
        if uses[node] == 1:
            for a in node.args:
                walk(a)

    for n in nodes:
        walk(n)
    depth: dict[Node, int] = {}

    def level(node: Node) -> int:
        """Layers of shared parts up to and with ``node``."""
        if node not in depth:
            depth[node] = max((level(a) for a in node.args), default=0) + (uses[node] > 1 and bool(node.args))
        return depth[node]

    layers: list[list[Node]] = []
    for node, n in uses.items():
        if n > 1 and node.args:
            layers += [[] for _ in range(level(node) - len(layers))]
            layers[level(node) - 1].append(node)
    return layers


def evaluate_graph(rows: DataFrame, nodes: list[Node], names: list[str], dialect: str = "plain", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and a column per formula, undefined values as null. Each sub-formula that several of them share, or one
    has twice, is a column of its own and computed once; equal up to the order of symmetric operators is equal."""
    nodes, made = [canonical(n) for n in nodes], {}
    for layer in shared_parts(nodes):
        new = {n: f"_part{len(made) + k}" for k, n in enumerate(layer)}
        rows = rows.withColumns({c: compile_node(n, dialect, made) for n, c in new.items()})
        made |= new
    return rows.select(*keep, *(_safe(compile_node(n, dialect, made)).alias(c) for n, c in zip(nodes, names, strict=True)))


def compile_text(text: str, dialect: str = "plain") -> Column:
    return _safe(compile_node(parse(text), dialect))


def evaluate(rows: DataFrame, formulas: list[str], dialect: str = "plain", prefix: str = "f", chunk: int = 48) -> DataFrame:
    """``rows`` and a column per formula. Long lists go in chunks, so that a projection stays within code generation."""
    for s in range(0, len(formulas), chunk):
        rows = rows.withColumns({f"{prefix}{s + k}": compile_text(t, dialect) for k, t in enumerate(formulas[s : s + chunk])})
    return rows


def score(rows: DataFrame, formulas: list[str], weights: list[float], dialect: str = "plain", skip_zero: bool = True) -> DataFrame:
    """``alpha``: the weighted sum of formulas. An undefined value makes it null; with ``skip_zero`` those of weight 0
    are left out (without, they count as undefined too)."""
    if len(formulas) != len(weights):
        raise ValueError(f"{len(formulas)} formulas but {len(weights)} weights")
    alpha = F.lit(0.0)
    for text, w in zip(formulas, weights, strict=True):
        if w != 0 or not skip_zero:
            alpha = alpha + compile_text(text, dialect) * F.lit(float(w))
    return rows.withColumn("alpha", alpha)


def first_occurrences(formulas: DataFrame) -> DataFrame:
    """``formula, idx`` of the first place of each formula text in ``idx, formula``."""
    return formulas.groupBy("formula").agg(F.min("idx").alias("idx"))


def explain_nodes(rows: DataFrame, text: str, dialect: str = "plain", key: str = "ticker") -> DataFrame:
    """``key, node_id, parent_id, depth, label, value``: every sub-formula of each row, in reading order."""
    found: list[tuple[int, int | None, int, Node]] = []

    def walk(node, parent, depth):
        me = len(found)
        found.append((me, parent, depth, node))
        for a in node.args:
            walk(a, me, depth + 1)

    walk(parse(text), None, 0)
    each = F.array(
        *(
            F.struct(F.lit(i).alias("node_id"), F.lit(p).cast("int").alias("parent_id"), F.lit(d).alias("depth"), F.lit(f"{n.value:.4g}" if n.op == "const" else show(n)).alias("label"), _safe(compile_node(n, dialect)).alias("value"))
            for i, p, d, n in found
        )
    )
    return rows.select(key, F.explode(each).alias("n")).select(key, "n.*")


def render(nodes: list) -> list[str]:
    """Tree drawing of one row's explanation (rows of ``explain_nodes``)."""
    below: dict = {}
    for r in sorted(nodes, key=lambda r: r["node_id"]):
        below.setdefault(r["parent_id"], []).append(r)
    lines: list[str] = []

    def draw(r, lead, last, root):
        value = "undefined" if r["value"] is None else f"{r['value']:.4g}"
        lines.append(f"{lead}{'' if root else '└─ ' if last else '├─ '}{r['label']} = {value}")
        kids = below.get(r["node_id"], [])
        for k, child in enumerate(kids):
            draw(child, lead if root else lead + ("   " if last else "│  "), k == len(kids) - 1, False)

    for r in below.get(None, []):
        draw(r, "", True, True)
    return lines
