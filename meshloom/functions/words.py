"""Word functions: pure Python cores for branch-and-cycle words, and column expressions for what SQL can say.

A word is node characters with cycle labels (digits, runs separated by %) and branches in brackets.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Node characters; a type's character is its place in this list.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_NODE = re.compile("[A-Za-z]")
_DIGITS = "0123456789"


def tokens(word: str) -> list[tuple[int, str, str]]:
    """(position, kind, text): kind is node, open, close, label or other. A label is a maximal run of digits."""
    out = []
    for m in re.finditer(r"\d+|.", word, re.S):
        t = m[0]
        kind = "label" if t[0].isdigit() else "open" if t == "(" else "close" if t == ")" else "node" if _NODE.match(t) else "other"
        out.append((m.start(), kind, t))
    return out


def edges(word: str) -> list[tuple[int, int, int]]:
    """(position, a, b): the edge that each character of the word stands for, nodes numbered from 0 in order.

    A node's character stands for the edge to its parent; every digit of a label that closes a cycle stands for the cycle's
    edge. Other characters stand for none. Unbalanced brackets and labels never closed give no edge.
    """
    out, stack, last, n, opened = [], [], None, 0, {}
    for pos, kind, t in tokens(word):
        if kind == "node":
            if last is not None:
                out.append((pos, n, last))
            last, n = n, n + 1
        elif kind == "open":
            stack.append(last)
        elif kind == "close" and stack:
            last = stack.pop()
        elif kind == "label" and last is not None:
            if t in opened:
                other = opened.pop(t)
                out += [(pos + i, last, other) for i in range(len(t))]
            else:
                opened[t] = last
    return out


def node_chars(word: str) -> list[str]:
    return _NODE.findall(word)


def pairs_and_degrees(word: str) -> tuple[set[tuple[str, str]], set[tuple[str, int]]]:
    """Neighbouring characters in both orders, and (character, degree) of each node: as `needs` counts where the word is well formed, else by distinct neighbours."""
    need = needs(word)
    if need is not None:
        pairs = {(x[1], x[2]) for x in need if x[0] == "p"}
        return pairs | {(b, a) for a, b in pairs}, {(x[1], int(x[2:])) for x in need if x[0] == "d"}
    chars, seen = node_chars(word), {(min(a, b), max(a, b)) for _, a, b in edges(word)}
    degree, pairs = Counter(), set()
    for a, b in seen:
        degree[a] += 1
        degree[b] += 1
        pairs |= {(chars[a], chars[b]), (chars[b], chars[a])}
    return pairs, {(c, degree[i]) for i, c in enumerate(chars)}


def needs(word: str) -> list[str] | None:
    """What a grammar must know for a word to be right: "c" and a node's character, "p" and the characters of each edge, "d" and
    each node's character and degree. None if the word is not well formed (WD5).

    Well formed: a node's character, its labels with one % after each at most, its branches in brackets, and the node that
    goes on; brackets close, every digit occurs an even number of times. A node's degree counts the edge to its parent, its
    labels, its branches and the node that goes on. A label stands for an edge to the node that had it first; one that closes
    on its own node needs no pair.
    """
    if not word or word.count("(") != word.count(")") or any(word.count(d) % 2 for d in "0123456789"):
        return None
    found: set[str] = set()
    degree: list[int] = []
    chars: list[str] = []
    first: dict[str, int] = {}
    stack: list[int] = []
    at, i, fresh = None, 0, False  # the node that comes before, the place, whether a node must come
    while i < len(word):
        c = word[i]
        if c == "(" and at is not None and not fresh:
            stack.append(at)
            fresh, i = True, i + 1
        elif c == ")" and stack and not fresh:
            at, i = stack.pop(), i + 1
        elif _NODE.match(c):
            n = len(chars)
            chars.append(c)
            degree.append(0)
            if at is not None:
                degree[at] += 1
                degree[n] += 1
                found.add("p" + chars[at] + c)
            at, fresh, i = n, False, i + 1
            while i < len(word) and word[i] in _DIGITS:
                j = i
                while j < len(word) and word[j] in _DIGITS:
                    j += 1
                other = first.setdefault(str(int(word[i:j])), n)
                degree[n] += 1
                if other != n:
                    found.add("p" + c + chars[other])
                i = j + (j < len(word) and word[j] == "%")
        else:
            return None
    if stack or fresh:
        return None
    return sorted(found | {"c" + c for c in chars} | {f"d{c}{n}" for c, n in zip(chars, degree)})


def signature(word: str) -> str:
    """Equal for words with equal digit counts, node counts and undirected edge-type counts; else different."""
    chars = node_chars(word)
    nodes = Counter(chars)
    digit = Counter(c for c in word if c.isdigit())
    kinds = Counter("".join(sorted((chars[a], chars[b]))) for _, a, b in edges(word))
    part = lambda c: ",".join(f"{k}{n}" for k, n in sorted(c.items()))
    return "|".join((part(nodes), part(digit), part(kinds)))


def encode(start: int, chars: dict, adjacent: dict[int, list[int]]) -> tuple[str, list[int]]:
    """The word of a connected graph from a start node, and the node of each node character.

    Depth first, neighbours in the order given; edges back to visited nodes become numbered cycles. Iterative, so that long
    chains don't exhaust the stack.
    """
    number, parent, children, order = {}, {start: None}, defaultdict(list), []
    stack = [(start, iter(adjacent.get(start, ())))]
    labels: dict[int, list[int]] = defaultdict(list)
    order.append(start)
    while stack:
        v, it = stack[-1]
        for w in it:
            if w not in parent:
                parent[w] = v
                children[v].append(w)
                order.append(w)
                stack.append((w, iter(adjacent.get(w, ()))))
                break
            if w != parent[v] and w != v and (min(v, w), max(v, w)) not in number:
                k = number[min(v, w), max(v, w)] = len(number) + 1
                labels[v].append(k)
                labels[w].append(k)
        else:
            stack.pop()
    out, todo, nodes = [], [start], []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        nodes.append(x)
        out.append(chars[x] + "%".join(map(str, labels[x])))
        kids = children[x]
        for i, w in reversed(list(enumerate(kids))):
            todo += [w] if i == len(kids) - 1 else [")", w, "("]
    return "".join(out), nodes


def graph(word: str) -> tuple[list[str], dict[int, list[int]]]:
    """Node characters and neighbours of a word's nodes."""
    adjacent: dict[int, list[int]] = defaultdict(list)
    for _, a, b in edges(word):
        if b not in adjacent[a]:
            adjacent[a].append(b)
            adjacent[b].append(a)
    return node_chars(word), adjacent


def type_char(index: Column) -> Column:
    """The node character of a type index (WD3)."""
    return F.substring(F.lit(ALPHABET), index.cast("int") + 1, F.lit(1))


def strip_cycles(word: Column) -> Column:
    return F.regexp_replace(word, "[0-9%]", "")


def well_formed(word: Column) -> Column:
    """The cheap checks: as many brackets open as close, every digit even (WD5)."""
    ok = F.regexp_count(word, F.lit("[(]")) == F.regexp_count(word, F.lit("[)]"))
    for d in "0123456789":
        ok = ok & (F.regexp_count(word, F.lit(d)) % 2 == 0)
    return ok


def distance(a: Column, b: Column, chars: str = ALPHABET) -> Column:
    """Sum over characters of the difference of their counts, by both words' node counts; null if neither has a node (AG4)."""
    n = F.regexp_count(a, F.lit("[A-Za-z]")) + F.regexp_count(b, F.lit("[A-Za-z]"))
    diff = F.lit(0)
    for c in chars:
        diff = diff + F.abs(F.regexp_count(a, F.lit(c)) - F.regexp_count(b, F.lit(c)))
    return F.when(n > 0, diff / n)
