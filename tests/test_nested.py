import json
import random

from codeloom.operators import nested

BAD = ["", "  ", "{", "[1,2", '{"a":1,}', '{"a" 1}', '"x', '{"type":"a"}x', "nul", '{"a":"\\x"}', '{"a":[}]}', "01", "[1 2]", '{"a":"b""c"}', "{1:2}", "]", "}{", '{"a":"\x01"}', '{"a":tru}', "[,]", '{"a":1,"b"}', '{"a"::1}', '["\\u12"]']


def model(text):
    try:
        j = json.loads(text)
    except Exception:
        return []
    out, n = [], [0]

    def node(o, up):
        me = n[0]
        n[0] += 1
        out.append(("node", up, me))
        for k in ("metadata", "attributes"):
            m = o.get(k)
            if isinstance(m, str):
                try:
                    m = json.loads(m)
                except Exception:
                    m = None
            for a, b in m.items() if isinstance(m, dict) else ():
                out.extend((a, me, i) for i, z in enumerate(b if isinstance(b, list) else []) if isinstance(z, dict))
        c = o.get("children")
        for z in c if isinstance(c, list) else [c]:
            if isinstance(z, dict):
                node(z, me)

    j = j["ast"] if isinstance(j, dict) and "ast" in j else j
    for z in j if isinstance(j, list) else [j]:
        if isinstance(z, dict):
            node(z, -1)
    return out


def tree(r, d=0):
    o = {"type": r.choice("abc"), "name": r.choice(["x", 'q"uo\\te', "größe ", "{[,:]}", ""])}
    m = {k: r.choice([None, 1, "[{}]", [], [{"n": 1}, "s", {"m": [{}]}, None], {"a": [{}]}]) for k in r.sample(["p", "q\n", "dé"], 2)}
    o[r.choice(["metadata", "attributes"])] = r.choice([m, m, json.dumps(m), None, [1]])
    if d < 4:
        kids = [r.choice([None, tree(r, d + 1), tree(r, d + 1)]) for _ in range(r.randint(0, 3))]
        o["children"] = r.choice([kids, kids, tree(r, d + 1), None])
    return o


def test_like_json_module(spark):
    r = random.Random(11)
    texts = list(BAD)
    for i in range(120):
        t = tree(r)
        t = r.choice([t, [t, None, tree(r)], {"path": "p", "ast": t}, {"ast": [t, tree(r)], "errors": []}])
        texts.append(json.dumps(t, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])))
    texts += [x[: len(x) // 2] for x in texts[-10:]] + ['{"ast":null}', "[]", "{}", "null", "3"]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)] + [(None, "{}", ""), (9999, None, "")], "record_id BIGINT, payload STRING, entity STRING")
    got = {}
    for x in nested.linked_rows(df.union(df)).collect():
        got.setdefault(x.record_id, []).append((x.entity, x.owner_no, x.item_no))
    for i, t in enumerate(texts):
        assert sorted(got.pop(i, [])) == sorted(set(model(t))), t
    assert not got


def test_fields_and_empty(spark, rows):
    df = spark.createDataFrame([(1, '{"type":"f","name":"\\u00e4","start_line":"3","metadata":{"k":[{"name":"v"}]}}')], "record_id BIGINT, payload STRING")
    assert rows(nested.linked_rows(df)) == [(1, "k", 0, 0, None, None, None, None, '{"name":"v"}'), (1, "node", -1, 0, "f", "ä", "3", None, None)]
    assert nested.linked_rows(df.limit(0)).count() == 0


def test_very_long_and_deep(spark):
    deep = '{"children":[' * 400 + "{}" + "]}" * 400
    wide = json.dumps({"children": [{"name": "x" * 50}] * 20000})
    df = spark.createDataFrame([(1, deep), (2, wide)], "record_id BIGINT, payload STRING")
    assert {r[0]: r[1] for r in nested.linked_rows(df).groupBy("record_id").count().collect()} == {1: 401, 2: 20001}
