"""The steps of ``hierarchy.euler_forest`` over blocks of nodes; see there for the method.

Node n is ``block << 32 | slot``; its tour elements are 2n (entered) and 2n + 1 (left), and -1 is no node or element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from codeloom.operators.blocks import Inbox, Sent, numbers, packed, scatter, split

LOW = (1 << 32) - 1
ELOW = (1 << 33) - 1


def _first(keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted keys."""
    return np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]


def _names(box: Inbox) -> pa.Table:
    return box.tables("names")[0][1]


def number(block: int, t: pa.Table) -> Iterator[Sent]:
    """Nodes get their slots; each distinct parent is asked for once."""
    names = t.select(["id", "parent", "name"]).combine_chunks()
    yield packed(block, block, "names", names)
    d = pc.dictionary_encode(names.column("parent").combine_chunks() if names.num_rows else names.column("parent"))
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    code = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    to = np.empty(len(d.dictionary), np.int64)
    has = code >= 0
    to[code[has]] = t.column("up").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)[has]
    yield numbers(block, block, "code", code)
    for dst, rows in split(to):
        yield packed(block, dst, "ask", pa.table({"parent": d.dictionary.take(pa.array(rows)), "code": rows}))


def resolve(box: Inbox) -> Iterator[Sent]:
    """Parents are told to their children's blocks; who is asked for has children."""
    b, ids = box.block, (box.tables("names") or [(0, pa.table({"id": pa.array([], pa.string())}))])[0][1].column("id")
    inner = np.zeros(len(ids), np.int64)
    asks = box.tables("ask")
    if asks:
        at = pc.index_in(pa.chunked_array([c for _, a in asks for c in a.column("parent").chunks], pa.string()), value_set=ids.combine_chunks()).fill_null(-1).to_numpy().astype(np.int64)
        inner[at[at >= 0]] = 1
        begin = 0
        for src, a in asks:
            mine = at[begin : begin + len(a)]
            begin += len(a)
            yield numbers(b, src, "parents", a.column("code").to_numpy(), np.where(mine >= 0, b << 32 | mine, -1))
    if len(ids):
        yield numbers(b, b, "code", box.numbers("code", 1)[0])
        yield numbers(b, b, "inner", inner)


def siblings(box: Inbox) -> Iterator[Sent]:
    """The children of one parent in this block form a run: inner ones are chained, leaves counted."""
    b, code, inner = box.block, box.numbers("code", 1)[0], box.numbers("inner", 1)[0]
    m, found = len(code), box.numbers("parents", 2)
    of = np.full(found.shape[1] + 1, -1, np.int64)  # the last one is that of code -1
    of[found[0]] = found[1]
    p = of[code]
    sib, prev, nth = np.full(m, -1, np.int64), np.full(m, -1, np.int64), np.zeros(m, np.int64)
    runs = []
    for kind in (1, 0):
        s = np.flatnonzero((p >= 0) & (inner == kind))
        s = s[np.argsort(p[s], kind="stable")]
        new = _first(p[s])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(s))[: len(begin)]
        if kind:
            same = np.flatnonzero(~new)
            sib[s[same - 1]], prev[s[same]] = b << 32 | s[same], b << 32 | s[same - 1]
            runs.append((p[s[begin]], b << 32 | s[begin], b << 32 | s[end - 1], np.zeros(len(begin), np.int64)))
        else:
            nth[s] = np.arange(len(s)) - np.repeat(begin, end - begin)
            none = np.full(len(begin), -1, np.int64)
            runs.append((p[s[begin]], none, none, end - begin))
    run = [np.concatenate(c) for c in zip(*runs)]
    yield from scatter(b, run[0] >> 32, "runs", *run)
    yield numbers(b, b, "nodes", p, inner, sib, prev, nth)


def link(box: Inbox) -> Iterator[Sent]:
    """A parent joins the runs of its children, in order of their blocks: at most one of inner nodes and one of leaves from each."""
    b, (p, first, last, leaves), src = box.block, box.numbers("runs", 4), box.senders("runs", 4)
    order = np.argsort(p, kind="stable")
    p, first, last, leaves, src = p[order], first[order], last[order], leaves[order], src[order]
    new = _first(p)
    of = np.cumsum(new) - 1
    sums = np.cumsum(leaves)
    begin = np.flatnonzero(new)
    before = sums - leaves
    before = before - before[begin][of] if len(p) else before
    i = np.flatnonzero(first >= 0)
    after, ahead = np.full(len(i), -1, np.int64), np.full(len(i), -1, np.int64)
    same = np.flatnonzero(p[i][1:] == p[i][:-1])
    after[same], ahead[same + 1] = first[i][same + 1], last[i][same]
    yield from scatter(b, src[i], "joins", first[i], last[i], after, ahead)
    j = np.flatnonzero(leaves > 0)
    yield from scatter(b, src[j], "before", p[j], before[j])
    yield numbers(b, b, "spread", p[j], src[j])
    head, tail = np.full(len(begin), -1, np.int64), np.full(len(begin), -1, np.int64)
    head[of[i[ahead < 0]]], tail[of[i[after < 0]]] = first[i[ahead < 0]], last[i[after < 0]]
    yield numbers(b, b, "parents", p[begin], head, tail, np.bincount(of, leaves, len(begin)).astype(np.int64) if len(p) else np.empty(0, np.int64))
    if (nodes := box.numbers("nodes", 5)).shape[1]:
        yield numbers(b, b, "nodes", *nodes)


def tour(box: Inbox) -> Iterator[Sent]:
    """The tour's elements: what follows and precedes each, and what a step to the next counts: visits passed (leaves right after their parent is entered) and the change of depth."""
    b, (p, inner, sib, prev, nth) = box.block, box.numbers("nodes", 5).copy()
    first, last, after, ahead = box.numbers("joins", 4)
    sib[last[after >= 0] & LOW], prev[first[ahead >= 0] & LOW] = after[after >= 0], ahead[ahead >= 0]
    q, before = box.numbers("before", 2)
    order = np.argsort(q)
    leaf = np.flatnonzero((inner == 0) & (p >= 0))
    nth[leaf] += before[order][np.searchsorted(q[order], p[leaf])] if len(leaf) else 0
    own, head, tail, leaves = box.numbers("parents", 4)  # all inner nodes, and no others
    s = own & LOW
    up, down_to, enter, leave = p[s], sib[s], 2 * own, 2 * own + 1
    nxt = np.where(down_to >= 0, 2 * down_to, np.where(up >= 0, 2 * up + 1, leave))
    pred = np.where(up < 0, -1, np.where(prev[s] < 0, 2 * up, 2 * prev[s] + 1))
    one = np.ones(len(s), np.int64)
    rows = [np.concatenate(x) for x in ((enter, leave), (np.where(head >= 0, 2 * head, leave), nxt), (pred, np.where(tail >= 0, 2 * tail + 1, enter)), (1 + 2 * leaves, one), (-one, one))]
    stays = np.concatenate([np.zeros(len(s), bool), (up < 0) & (down_to < 0)])  # ends of tours
    yield numbers(b, b, "cur", *(c[~stays] for c in rows))
    yield numbers(b, b, "nodes", p, inner, nth)
    yield numbers(b, b, "spread", *box.numbers("spread", 2))


def _toss(el: np.ndarray, k: int) -> np.ndarray:
    """A hash of element and round, the same in every block."""
    x = el.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    for by, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(mul)
    return x ^ (x >> np.uint64(31))


def _current(box: Inbox) -> tuple[np.ndarray, np.ndarray, list[Sent]]:
    """Elements after what the last round spliced out of them, what is left of circles, and whom each element owes its sums."""
    b, cur = box.block, box.numbers("cur", 5).copy()
    el, nxt, pred, steps, down = cur
    order = np.argsort(el)
    at = lambda x: order[np.searchsorted(el, x, sorter=order)]
    to, new, more, deeper = box.numbers("after", 4)
    if len(to):
        i = at(to)
        nxt[i] = new
        steps[i] += more
        down[i] += deeper
    x, new, r = box.numbers("ahead", 3)
    if len(x):
        ends = ~np.isin(x, el)  # ends of tours: what precedes them is of no use
        pred[at(x[~ends])] = new[~ends]
    lone = el == nxt
    return cur[:, ~lone], el[lone], [numbers(b, b, "owes", x, r)] if len(x) else []


def contract(k: int):
    """Round k: elements whose toss is above those of both neighbours, a third of all, are spliced out."""

    def f(box: Inbox) -> Iterator[Sent]:
        b, (cur, lone, owes) = box.block, _current(box)
        el, nxt, pred, steps, down = cur
        mine = _toss(el, k)
        out = (mine > _toss(nxt, k)) & ((pred < 0) | (mine > _toss(pred, k)))
        gone = cur[:, out]
        has = gone[2] >= 0
        yield from scatter(b, gone[2][has] >> 33, "after", *gone[[2, 1, 3, 4]][:, has])
        yield from scatter(b, gone[1] >> 33, "ahead", *gone[[1, 2, 0]])
        yield numbers(b, b, "gone", *gone[[0, 3, 4]])
        yield numbers(b, b, "cur", *cur[:, ~out])
        yield numbers(b, b, "lone", np.concatenate([box.numbers("lone", 1)[0], lone]))
        yield from owes

    return f


def gather(box: Inbox) -> Iterator[Sent]:
    """What is left goes to one task."""
    cur, lone, owes = _current(box)
    if cur.shape[1]:
        yield numbers(box.block, 0, "last", *cur[[0, 1, 3, 4]])
    yield numbers(box.block, box.block, "lone", np.concatenate([box.numbers("lone", 1)[0], lone]))
    yield from owes


def last(box: Inbox) -> Iterator[Sent]:
    """Pointer doubling over all elements left; what they point to outside of them are ends. A circle goes by its smallest element."""
    el, nxt, steps, down = box.numbers("last", 4)
    n = len(el)
    ends = np.setdiff1d(nxt, el)
    none = np.zeros(len(ends), np.int64)
    el, nxt, steps, down = np.concatenate([el, ends]), np.concatenate([nxt, ends]), np.concatenate([steps, none]), np.concatenate([down, none])
    order = np.argsort(el, kind="stable")
    to = order[np.searchsorted(el, nxt, sorter=order)]
    least = el
    for _ in range(n.bit_length()):
        steps, down, least, to = steps + steps[to], down + down[to], np.minimum(least, least[to]), to[to]
    far = np.where(to >= n, el[to], least)
    yield from scatter(box.block, el[:n] >> 33, "sums", el[:n], far[:n], steps[:n], down[:n], to[:n] >= n)


def begin(box: Inbox) -> Iterator[Sent]:
    """Ends of tours and what is left of circles are ranked, and what one task has ranked."""
    b, (p, inner, _), lone = box.block, box.numbers("nodes", 3), box.numbers("lone", 1)[0]
    ends = 2 * (b << 32 | np.flatnonzero((inner == 1) & (p < 0))) + 1
    both, zero = np.concatenate([ends, lone]), np.zeros(len(ends) + len(lone), np.int64)
    own = np.stack([both, both, zero, zero, np.arange(len(both)) < len(ends)]).astype(np.int64)
    yield numbers(b, b, "ranked", *np.concatenate([own, box.numbers("sums", 5)], axis=1))


def _ranked(box: Inbox) -> np.ndarray:
    """Ranked elements, with those that got the sums of what follows them."""
    got, gone, done = box.numbers("due", 5), box.numbers("gone", 3), box.numbers("ranked", 5)
    if not got.shape[1]:
        return done
    got, gone = got[:, np.argsort(got[0])], gone[:, np.argsort(gone[0])]
    got[2:4] += gone[1:]
    return np.concatenate([done, got], axis=1)


def restore(box: Inbox) -> Iterator[Sent]:
    """Elements tell their sums to those that one round spliced out ahead of them."""
    b, done, (x, r) = box.block, _ranked(box), box.numbers("owes", 2)
    if len(x):
        order = np.argsort(done[0])
        row = done[:, order[np.searchsorted(done[0], x, sorter=order)]]
        yield from scatter(b, r >> 33, "due", r, *row[1:])
    yield numbers(b, b, "ranked", *done)


def ask(box: Inbox) -> Iterator[Sent]:
    """The end of each tour and a circle's element are asked for the root or the smallest id on the loop.

    Loops: the two elements of a node on a loop lie on different circles.
    """
    b, done = box.block, _ranked(box)
    ids = _names(box).column("id").combine_chunks()
    done = done[:, np.argsort(done[0])]
    i, o = done[:, done[0] & 1 == 0], done[:, done[0] & 1 == 1]  # each inner node has both
    slot, a, c, tree = i[0] >> 1 & LOW, i[1], o[1], i[4]
    on = (tree == 0) & (a != c)
    keys, at = np.concatenate([a[on], c[on]]), np.tile(slot[on], 2)
    order = pc.sort_indices(ids.take(pa.array(at))).to_numpy() if len(at) else at
    least, where = np.unique(keys[order], return_index=True)
    for to, rows in split(least >> 33):
        yield packed(b, to, "least", pa.table({"key": least[rows], "id": ids.take(pa.array(at[order][where[rows]]))}))
    far = np.unique(a)
    yield from scatter(b, far >> 33, "far", far)
    root = (tree == 1) & (a >> 1 == i[0] >> 1)
    yield numbers(b, b, "roots", a[root], i[2][root])
    yield numbers(b, b, "placed", slot, a, tree, i[3] + 1, i[2], o[2], on)


def answer(box: Inbox) -> Iterator[Sent]:
    b, got, src = box.block, box.numbers("far", 1)[0], box.senders("far", 1)
    root, end = box.numbers("roots", 2)
    loops = box.tables("least")
    t = pa.concat_tables([x for _, x in loops]) if loops else pa.table({"key": pa.array([], pa.int64()), "id": pa.array([], pa.string())})
    t = t.take(pc.sort_indices(t, sort_keys=[("key", "ascending"), ("id", "ascending")]))
    least, where = np.unique(t.column("key").to_numpy(), return_index=True)
    ids = _names(box).column("id").combine_chunks() if len(root) else pa.array([], pa.string())
    key, end = np.concatenate([root, least]), np.concatenate([end, np.full(len(least), -1, np.int64)])
    text = pa.chunked_array([ids.take(pa.array(root >> 1 & LOW)), *t.column("id").take(pa.array(where)).chunks], pa.string())
    order = np.argsort(key)
    at = order[np.searchsorted(key, got, sorter=order)] if len(got) else got
    for to, rows in split(src):
        yield packed(b, to, "names of", pa.table({"key": got[rows], "end": end[at[rows]], "id": text.take(pa.array(at[rows]))}))
    if (placed := box.numbers("placed", 7)).shape[1]:
        yield numbers(b, b, "placed", *placed)


def _texts(tables: list[tuple[int, pa.Table]]) -> pa.Table:
    return pa.concat_tables([t for _, t in tables])


def place(box: Inbox) -> Iterator[Sent]:
    """Inner nodes have their places, and tell them to the blocks that hold leaves below them."""
    b, (slot, far, tree, depth, s_in, s_out, on) = box.block, box.numbers("placed", 7)
    if not len(slot):
        return
    t = _texts(box.tables("names of"))
    key, end = t.column("key").to_numpy(), t.column("end").to_numpy()
    order = np.argsort(key)
    at = order[np.searchsorted(key, far, sorter=order)]
    root = t.column("id").take(pa.array(at))
    depth = np.where(tree == 1, depth, np.where(on == 1, -1, -2))
    entry, out = np.where(tree == 1, end[at] - s_in, -1), np.where(tree == 1, end[at] - s_out, -1)
    mine = pa.table({"node": b << 32 | slot, "depth": depth, "entry": entry, "exit": out, "root_id": root})
    yield packed(b, b, "inner", mine)
    p, src = box.numbers("spread", 2)
    for to, rows in split(src):
        yield packed(b, to, "above", mine.take(pa.array(np.searchsorted(mine.column("node").to_numpy(), p[rows]))))


def rows(box: Inbox) -> pa.Table:
    """All nodes of the block. A lone root is a leaf without a parent; other leaves follow their parent's entry."""
    names, (p, inner, nth) = _names(box), box.numbers("nodes", 3)
    m = len(p)
    depth, entry, out, root = np.zeros(m, np.int64), np.zeros(m, np.int64), np.ones(m, np.int64), np.arange(m)
    pool = [*names.column("id").chunks]
    if got := box.tables("inner"):
        t = got[0][1]
        s = t.column("node").to_numpy() & LOW
        depth[s], entry[s], out[s] = (t.column(c).to_numpy() for c in ("depth", "entry", "exit"))
        root[s] = m + np.arange(len(s))
        pool += t.column("root_id").chunks
    leaf = np.flatnonzero((inner == 0) & (p >= 0))
    if len(leaf):
        t = _texts(box.tables("above"))
        key, size = t.column("node").to_numpy(), sum(map(len, pool))
        order = np.argsort(key)
        at = order[np.searchsorted(key, p[leaf], sorter=order)]
        above, first = t.column("depth").to_numpy()[at], t.column("entry").to_numpy()[at]
        depth[leaf] = np.where(above >= 0, above + 1, -2)
        entry[leaf], out[leaf] = first + 1 + 2 * nth[leaf], first + 2 + 2 * nth[leaf]
        root[leaf] = size + at
        pool += t.column("root_id").chunks
    off, none = depth < 0, pa.scalar(None, pa.string())
    parent = pc.if_else(pa.array(p >= 0), names.column("parent"), none)
    got = {"id": names.column("id"), "parent": parent, "name": names.column("name"), "root_id": pa.chunked_array(pool, pa.string()).take(pa.array(root))}
    return pa.table(got | {"depth": pa.array(depth, pa.int32()), "entry": pa.array(entry, mask=off), "exit": pa.array(out, mask=off)})
