"""Nested JSON records as linked flat rows, by vectorised structural indexing.

A batch of payloads is one byte buffer. Over it: a bitmap of escaped bytes (odd runs of backslashes), one of real quotes,
the inside of strings as the parity of quotes so far, and the brackets, colons and commas outside them. Depth is a
prefix sum over brackets. Sorting tokens by (payload, level, position) puts the members of a container behind its
opening bracket, which pairs brackets and links each value to its owner. Validity is then a local matter: which token may
stand behind which, given the kind of container. No payload is parsed into Python objects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

#: Bytes of payload indexed at a time; a longer payload makes a batch of its own.
BATCH_BYTES = 1 << 22

_SCALAR = re.compile(rb"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)\Z")
_CHILDREN, _META, _TREE = b"children", (b"metadata", b"attributes"), b"ast"
_FIELDS = {b"node_type": "node_type", b"type": "node_type", b"name": "name", b"start_line": "start_line", b"end_line": "end_line"}

# token kinds
OPEN_O, CLOSE_O, OPEN_A, CLOSE_A, COLON, COMMA, STRING, SCALAR = range(8)
_KIND = np.full(256, 255, np.uint8)
for _c, _k in zip(b"{}[]:,", range(6)):
    _KIND[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_ESC = np.zeros(256, bool)
_ESC[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


class Index:
    """Tokens of valid payloads: kind, start, end (past the last byte), doc, level, and for values owner (token of the opening bracket, -1 at the top), key (token or -1) and nth (place in the container)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.raw = data.tobytes()
        docs = len(offsets) - 1
        n = len(data)
        doc_of = np.repeat(np.arange(docs), np.diff(offsets))
        bad = np.zeros(docs, bool)

        slash = np.flatnonzero(data == 0x5C)
        escaped = np.zeros(n + 1, bool)
        if len(slash):
            first = np.ones(len(slash), bool)
            first[1:] = (slash[1:] != slash[:-1] + 1) | (doc_of[slash[1:]] != doc_of[slash[:-1]])
            start = slash[np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))]
            acting = slash[(slash - start) % 2 == 0]
            escaped[acting + 1] = True
            inside = acting[acting + 1 < offsets[doc_of[acting] + 1]]
            bad[doc_of[np.setdiff1d(acting, inside)]] = True
            bad[doc_of[inside[~_ESC[data[inside + 1]]]]] = True
            for u in (inside[data[inside + 1] == 0x75],):
                padded = np.concatenate([data, np.zeros(6, np.uint8)])
                ok = np.logical_and.reduce([_HEX[padded[u + k]] for k in range(2, 6)]) if len(u) else np.zeros(0, bool)
                bad[doc_of[u[~ok]]] = True
        quote = (data == 0x22) & ~escaped[:n]
        total = np.concatenate([[0], np.cumsum(quote, dtype=np.int64)])
        base = total[offsets[:-1]]
        parity_end = (total[offsets[1:]] - base) % 2
        bad |= parity_end == 1
        in_string = ((total[:-1] - base[doc_of]) % 2).astype(bool)  # before the byte: true from behind the opening to the closing quote
        bad[doc_of[in_string & (data < 0x20)]] = True
        bad[doc_of[slash[~in_string[slash]]]] = True

        kind = np.where(in_string, 255, _KIND[data])
        opening = quote & ~in_string
        other = ~in_string & ~quote & (kind == 255) & ~_SPACE[data]
        before = np.concatenate([[False], other[:-1]])
        same = np.concatenate([[False], doc_of[1:] == doc_of[:-1]])
        begins = other & ~(before & same)
        after = np.concatenate([other[1:], [False]])
        same_next = np.concatenate([same[1:], [False]])
        ends = np.flatnonzero(other & ~(after & same_next)) + 1
        kind = np.where(opening, STRING, np.where(begins, SCALAR, kind)).astype(np.uint8)
        pos = np.flatnonzero(kind != 255)
        kind = kind[pos]
        doc = doc_of[pos]
        end = pos + 1
        scalars = np.flatnonzero(kind == SCALAR)
        end[scalars] = ends
        closing = np.flatnonzero(quote & in_string)
        strings = np.flatnonzero(kind == STRING)
        m = min(len(closing), len(strings))
        if len(closing) == len(strings):
            end[strings] = closing + 1
        else:  # some payload ends inside a string: pair within each payload
            opened = pos[strings]
            at = np.searchsorted(closing, opened)
            end[strings] = np.where(at < len(closing), closing[np.minimum(at, max(m - 1, 0))] + 1 if len(closing) else 0, n)
        known: dict[bytes, bool] = {}
        for t in scalars.tolist():
            s = self.raw[pos[t] : end[t]]
            ok = known.get(s)
            if ok is None:
                ok = known[s] = bool(_SCALAR.match(s))
            if not ok:
                bad[doc[t]] = True

        step = np.where((kind == OPEN_O) | (kind == OPEN_A), 1, np.where((kind == CLOSE_O) | (kind == CLOSE_A), -1, 0))
        run = np.cumsum(step)
        first_token = np.searchsorted(doc, np.arange(docs))
        start_run = np.concatenate([[0], run])[first_token]
        after_level = run - start_run[doc]
        level = np.where(step > 0, after_level - 1, after_level)  # of a bracket: that of its container
        bad[doc[level < 0]] = True
        last_token = np.searchsorted(doc, np.arange(docs), "right") - 1
        has = first_token <= last_token
        bad |= ~has
        bad[has] |= after_level[last_token[has]] != 0

        t = len(pos)
        op = np.flatnonzero(step > 0)
        entry = np.concatenate([np.arange(t), op])
        lvl = np.concatenate([level, level[op] + 1])
        mark = np.concatenate([np.zeros(t, bool), np.ones(len(op), bool)])
        place = np.concatenate([np.arange(t) * 2, op * 2 + 1])
        order = np.lexsort((place, lvl, doc[entry]))
        e, mk, lv = entry[order], mark[order], lvl[order]
        group = np.ones(len(e), bool)
        group[1:] = (lv[1:] != lv[:-1]) | (doc[e[1:]] != doc[e[:-1]])
        here = np.arange(len(e))
        lead = np.maximum.accumulate(np.where(group | mk, here, 0))
        own = np.where(mk[lead], e[lead], -1)
        owner = np.full(t, -1)
        owner[e[~mk]] = own[~mk]
        # closing brackets stand at their container's level: the partner is the last opening at that level
        opened = np.maximum.accumulate(np.where(~mk & (step[e] > 0), here, -1))
        partner = np.full(t, -1)
        cl = ~mk & (step[e] < 0)
        partner[e[cl]] = np.where(opened[cl] >= 0, e[np.maximum(opened[cl], 0)], -1)
        closers = np.flatnonzero(step < 0)
        p = partner[closers]
        wrong = (p < 0) | (kind[np.maximum(p, 0)] + 1 != kind[closers]) | (doc[np.maximum(p, 0)] != doc[closers])
        bad[doc[closers[wrong]]] = True
        fine = closers[~wrong]
        close_of = np.full(t, -1)
        close_of[partner[fine]] = fine

        # what stands before each token; at a payload's start there is nothing
        prev = np.concatenate([[255], kind[:-1]]).astype(np.int64)
        prev[first_token[has]] = 255
        in_obj = (owner >= 0) & (kind[np.maximum(owner, 0)] == OPEN_O)
        in_arr = (owner >= 0) & ~in_obj
        value_before = np.isin(prev, (CLOSE_O, CLOSE_A, STRING, SCALAR))
        value = np.isin(kind, (OPEN_O, OPEN_A, STRING, SCALAR))
        is_key = (kind == STRING) & in_obj & np.isin(prev, (OPEN_O, COMMA))
        prev_is_key = np.concatenate([[False], is_key[:-1]])
        ok = np.ones(t, bool)
        v = value & ~is_key
        ok[v] = ((prev == 255) & (owner < 0) | in_obj & (prev == COLON) | in_arr & np.isin(prev, (OPEN_A, COMMA)))[v]
        c = kind == COLON
        ok[c] = (prev_is_key & in_obj)[c]
        c = kind == COMMA
        ok[c] = (value_before & ~prev_is_key & (in_obj | in_arr))[c]
        c = step < 0  # level of a closing bracket is its container's: judge by the partner
        ok[c] = ((prev == OPEN_O) & (kind == CLOSE_O) | (prev == OPEN_A) & (kind == CLOSE_A) | value_before & ~prev_is_key)[c]
        bad[doc[~ok]] = True
        self.bad, self.kind, self.pos, self.end, self.doc, self.owner, self.close_of, self.level = bad, kind, pos, end, doc, owner, close_of, level

        self.value = np.flatnonzero(v & ~bad[doc])
        key = np.full(t, -1)
        objv = self.value[in_obj[self.value]]
        key[objv] = objv - 2
        self.key = key
        nth = np.zeros(t, np.int64)
        arrv = self.value[in_arr[self.value]]
        if len(arrv):
            o = np.argsort(owner[arrv], kind="stable")
            s = arrv[o]
            new = np.ones(len(s), bool)
            new[1:] = owner[s[1:]] != owner[s[:-1]]
            i = np.arange(len(s))
            nth[s] = i - np.maximum.accumulate(np.where(new, i, 0))
        self.nth = nth

    def text(self, t: int) -> bytes:
        """Raw bytes of a token; of a bracket, up to its partner."""
        e = self.end[self.close_of[t]] if self.kind[t] in (OPEN_O, OPEN_A) else self.end[t]
        return self.raw[self.pos[t] : e]


def _unescape(raw: bytes) -> str:
    """The text of a string token without its quotes."""
    s = raw[1:-1].decode("utf-8", "replace")
    if "\\" not in s:
        return s
    s = re.sub(r'\\(?:u([0-9a-fA-F]{4})|(.))', lambda m: chr(int(m[1], 16)) if m[1] else {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}.get(m[2], m[2]), s, flags=re.S)
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _index(texts: list[bytes]) -> Index:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return Index(np.frombuffer(b"".join(texts), np.uint8), offsets)


def _items(x: Index, metas: np.ndarray, owners: np.ndarray, keys: dict[int, bytes], texts: bool) -> tuple[list, list, list, list]:
    """Objects standing in arrays directly under a key of the objects ``metas`` (tokens), whose nodes' rows are ``owners``."""
    at = np.full(len(x.kind), -1)
    at[metas] = owners
    v = x.value
    ow = x.owner[v]
    arrays = v[(x.kind[v] == OPEN_A) & (ow >= 0)]
    arrays = arrays[at[x.owner[arrays]] >= 0]
    under = np.full(len(x.kind), -1)
    under[arrays] = at[x.owner[arrays]]
    objs = v[(x.kind[v] == OPEN_O) & (ow >= 0)]
    objs = objs[under[x.owner[objs]] >= 0]
    names, cache = [], {}
    for k in x.key[x.owner[objs]].tolist():
        raw = keys[k]
        s = cache.get(raw)
        if s is None:
            s = cache[raw] = _unescape(raw)
        names.append(s)
    return under[x.owner[objs]].tolist(), names, x.nth[objs].tolist(), [x.text(o).decode("utf-8", "replace") for o in objs.tolist()] if texts else [None] * len(objs)


def _flatten(ids: list, texts: list[bytes], out: dict[str, list], with_fields: bool = True) -> None:
    x = _index(texts)
    v = x.value
    obj_keys = np.unique(x.key[v][x.key[v] >= 0])
    keys = {k: x.raw[s:e] for k, s, e in zip(obj_keys.tolist(), x.pos[obj_keys].tolist(), x.end[obj_keys].tolist())}
    of_key: dict[bytes, bytes] = {}
    names = {}
    for k, raw in keys.items():
        s = of_key.get(raw)
        if s is None:
            s = of_key[raw] = _unescape(raw).encode("utf-8", "replace") if b"\\" in raw else raw[1:-1]
        names[k] = s
    role = {_CHILDREN: 1, _META[0]: 2, _META[1]: 2, _TREE: 3} | {k: i for i, k in enumerate(_FIELDS, 4)}
    code = np.zeros(len(x.kind), np.int8)  # 1 children, 2 metadata, 3 the tree of a wrapped record, from 4 on fields
    code[obj_keys] = [role.get(s, 0) for s in names.values()]
    under = np.where(x.key >= 0, code[np.maximum(x.key, 0)], 0)

    opens = v[(x.kind[v] == OPEN_O) | (x.kind[v] == OPEN_A)]
    top = opens[x.owner[opens] < 0]
    wrapped = np.zeros(len(x.kind), bool)  # top objects that only hold the tree
    holds = opens[(under[opens] == 3) & (x.owner[opens] >= 0)]
    holds = holds[x.owner[x.owner[holds]] < 0]
    tree_keys = v[(under[v] == 3) & (x.owner[v] >= 0)]
    wrapped[x.owner[tree_keys[x.owner[x.owner[tree_keys]] < 0]]] = True
    is_node = np.zeros(len(x.kind), bool)
    parent = np.full(len(x.kind), -1)
    kids = np.zeros(len(x.kind), bool)  # arrays whose objects are nodes
    kid_parent = np.full(len(x.kind), -1)
    starts = np.concatenate([top[~wrapped[top]], holds[wrapped[x.owner[holds]]]]).astype(np.int64)
    is_node[starts[x.kind[starts] == OPEN_O]] = True
    kids[starts[x.kind[starts] == OPEN_A]] = True
    by_level = opens[np.argsort(x.level[opens], kind="stable")]
    cuts = np.flatnonzero(np.diff(x.level[by_level])) + 1
    for part in np.split(by_level, cuts):
        o = x.owner[part]
        has = o >= 0
        part, o = part[has], o[has]
        child = is_node[o] & (under[part] == 1)
        one = part[child & (x.kind[part] == OPEN_O)]
        is_node[one] = True
        parent[one] = x.owner[one]
        many = part[child & (x.kind[part] == OPEN_A)]
        kids[many] = True
        kid_parent[many] = x.owner[many]
        of = part[kids[o] & (x.kind[part] == OPEN_O)]
        is_node[of] = True
        parent[of] = kid_parent[x.owner[of]]
    nodes = np.flatnonzero(is_node)
    number = np.full(len(x.kind), -1)
    d = x.doc[nodes]
    if len(nodes):
        new = np.ones(len(nodes), bool)
        new[1:] = d[1:] != d[:-1]
        i = np.arange(len(nodes))
        number[nodes] = i - np.maximum.accumulate(np.where(new, i, 0))
    row_of = np.full(len(x.kind), -1)
    row_of[nodes] = np.arange(len(nodes))
    fields: dict[str, list] = {f: [None] * len(nodes) for f in ("node_type", "name", "start_line", "end_line")}
    direct = v[(x.owner[v] >= 0)]
    direct = direct[is_node[x.owner[direct]] & (x.kind[direct] >= STRING) & (under[direct] > 3)] if with_fields else direct[:0]
    of = list(_FIELDS.values())
    for r, k, s, e in zip(row_of[x.owner[direct]].tolist(), under[direct].tolist(), x.pos[direct].tolist(), x.end[direct].tolist()):
        raw = x.raw[s:e]
        fields[of[k - 4]][r] = _unescape(raw) if raw[:1] == b'"' else None if raw == b"null" else raw.decode()
    out["record_id"] += [ids[q] for q in d.tolist()]
    out["entity"] += ["node"] * len(nodes)
    out["owner_no"] += np.where(parent[nodes] >= 0, number[np.maximum(parent[nodes], 0)], -1).tolist()
    out["item_no"] += number[nodes].tolist()
    out["value"] += [None] * len(nodes)
    for f, col in fields.items():
        out[f] += col

    meta = v[(under[v] == 2) & (x.owner[v] >= 0)]
    meta = meta[is_node[x.owner[meta]]]
    mo = meta[x.kind[meta] == OPEN_O]
    found = [_items(x, mo, row_of[x.owner[mo]], keys, with_fields)]
    ms = meta[x.kind[meta] == STRING]
    if len(ms):  # metadata sent as text: index the texts in turn
        y = _index([_unescape(x.text(t)).encode() for t in ms.tolist()])
        tops = y.value[(y.owner[y.value] < 0) & (y.kind[y.value] == OPEN_O)]
        yk = np.unique(y.key[y.value][y.key[y.value] >= 0])
        found.append(_items(y, tops, row_of[x.owner[ms]][y.doc[tops]], {k: y.raw[s:e] for k, s, e in zip(yk.tolist(), y.pos[yk].tolist(), y.end[yk].tolist())}, with_fields))
    for owner, ent, nth, text in found:
        out["record_id"] += [ids[q] for q in d[owner].tolist()] if owner else []
        out["entity"] += ent
        out["owner_no"] += number[nodes[owner]].tolist() if owner else []
        out["item_no"] += nth
        out["value"] += text
        for f in fields:
            out[f] += [None] * len(ent)


_ROW = [("record_id", pa.int64()), ("entity", pa.string()), ("owner_no", pa.int32()), ("item_no", pa.int32()), ("node_type", pa.string()), ("name", pa.string()), ("start_line", pa.string()), ("end_line", pa.string()), ("value", pa.string())]
DDL = "record_id BIGINT, entity STRING, owner_no INT, item_no INT, node_type STRING, name STRING, start_line STRING, end_line STRING, value STRING"


def _run(batches: Iterator[pa.RecordBatch], fields: bool) -> Iterator[pa.RecordBatch]:
    names = [n for n, _ in (_ROW if fields else _ROW[:4])]
    for b in batches:
        ids, texts = pa.array(range(b.num_rows)), b.column(1).cast(pa.binary())
        records, times = b.column(0), b.column(2)
        sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(ids):
            size, to = 0, at
            while to < len(ids) and (to == at or size + sizes[to] <= BATCH_BYTES):
                size += sizes[to]
                to += 1
            out: dict[str, list] = {f: [] for f, _ in _ROW}
            _flatten(list(range(at, to)), texts[at:to].to_pylist(), out, fields)
            place = pa.array(out.pop("record_id"), pa.int64())
            cols = [records.take(place)] + [pa.array(out[f], t) for f, t in _ROW[1:] if f in names] + [times.take(place)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "_t"])
            at = to


def linked_rows(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload", time_col: str | None = None, fields: bool = True) -> DataFrame:
    """records → (record_id, entity, owner_no, item_no, node_type, name, start_line, end_line, value).

    One row per node (entity ``node``: item_no is its number in document order from 0, owner_no its parent's or -1) and per
    object in an array directly under a key of a node's metadata (entity: the key; owner_no: the node's number; item_no: the
    place in the array; value: the object's text). A record is a tree, an array of trees, or an object whose ``ast`` is one of
    these; ``children`` may be an array, one object or null; metadata may be an object or the text of one. Without fields only
    the first four columns are made.

    Null, empty and invalid payloads and null record ids yield nothing. Records delivered several times yield each row once,
    as delivered last by time_col (a null time is oldest; of equal times the greatest values count).
    Of fields given twice in one object the last counts, of children and metadata given twice both; a node's own fields keep their text, null where absent.
    """
    time = F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp")
    r = records.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(payload_col).alias("payload"), time.alias("_t")).where("record_id IS NOT NULL AND payload IS NOT NULL")
    keys = ["record_id", "entity", "owner_no", "item_no"]
    if not fields:
        ddl = DDL.split(", node_type")[0]
        return r.mapInArrow(lambda b: _run(b, False), ddl + ", _t TIMESTAMP").select(*keys).distinct()
    rows = r.mapInArrow(lambda b: _run(b, True), DDL + ", _t TIMESTAMP")
    v = F.struct("_t", *[n for n, _ in _ROW[4:]])
    return rows.groupBy(*keys).agg(F.max(v).alias("v")).select(*keys, *[F.col(f"v.{n}") for n, _ in _ROW[4:]])
