import random

import pytest

from codeloom.llm import grammar, mixing, packing, provenance, quality, syntax, tokens

GOOD = {
    "python": ["", "\ufeffx = 1\n", "import a.b as c\nfrom . import d\n\n@dec(1)\nclass K(B, metaclass=M):\n    '''doc\n======='''\n    x: int = 3\n    async def f(self, *a, k=1, **kw) -> int:\n        async with a as b, c:\n            return await z[1:2, ...]\n        try:\n            pass\n        except (A, B) as e:\n            raise X from e\n        else:\n            y = [i for i in j if k]\n        finally:\n            del q\nif a: b = 1\nelif not c in d: pass\nelse:\n\tg = lambda x, y=2: {**x, 'a': y}\nmatch v:\n    case [1, x] if x:\n        print(f'{x!r}')\n"],
    "javascript": ["#!/usr/bin/env node\nimport a, { b as c } from 'm';\nexport default class K extends L { #p = 1; static get x() { return /[/]\\/g/.test(s) } async *m(a = 1, ...r) { for await (const q of z) { yield q } } }\nconst f = async (a) => ({ a, [b]: 1, ...c, 'd': `x ${a ? `y` : 'z'} <<<<<<<` })\nlet t = a ? b : c ? d : e\nif (a) b()\nelse if (c) { d } else return2\nlabel: for (;;) { break label }\ntry { x() } catch { y() } finally {}\nswitch (a) { case 1: case 2: b(); break; default: c }\n!function(){}()\n", ""],
    "typescript": ["import type { A } from './a'\ninterface I<T> extends J { a?: string; b(x: number): void; [k: string]: any }\ntype U = 'a' | { b: number }\nenum E { A = 1, B }\nexport abstract class K<T> implements I<T> {\n  private readonly m: Map<string, number> = new Map<string, number>()\n  constructor(public a: string, b?: number) { super() }\n  get v(): string[] { return this.a as string[] }\n}\nconst f = <T>(x: T): T => x!.y\ndeclare namespace N { }\n"],
    "c": ["#include <a.h>\n#define X(a) \\\n  {{ a\ntypedef struct s { int a[3]; const char *b; } s_t;\nstatic const unsigned char d[] = { 0x1, 0x2, };\nint f(const char *a, struct s *b, ...) {\n  for (int i = 0; i < n; i++) { a[i] = (char) b->a[i] * 2; }\n  do { x--; } while (x > 0);\n  switch (q) { case 1: g(); break; default: ; }\n  if (a && *b) goto end; else return sizeof(int);\nend:\n  return a ? b : c;\n}\n"],
    "cpp": ["#include <x>\nnamespace a::b {\ntemplate <typename T, class U> class K : public L, private M {\npublic:\n  explicit K(int a) : L(a), m{1} {}\n  ~K() = default;\n  std::map<std::string, std::vector<int>> f(const T &t, U &&u) const noexcept override { auto l = [&](int x) { return x; }; return {}; }\n};\n}\nint main() { for (const auto &x : v) { std::cout << x << R\"(}})\"; } try { throw 1; } catch (const E &e) { } static_cast<int>(x); }\n"],
    "csharp": ["using System;\nusing X = Y.Z;\nnamespace A.B {\n  [Attr(1)]\n  public abstract class K<T> : L, IM<T> where T : class, new() {\n    public int P { get; private set; } = 3;\n    private readonly Dictionary<string, List<int>> d = new Dictionary<string, List<int>>();\n    public K(int a) : base(a) { }\n    public async Task<int?> F(ref int a, params string[] b) { foreach (var x in y) { await z(x => x.Q); } return a is string s ? (int)b : $\"{a:N2} }}\"; }\n    int G() => 1;\n  }\n}\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\ntype S struct {\n\tA int `json:\"a\"`\n\tB map[string][]*T\n}\n\ntype I interface {\n\tM(a int) (b string, err error)\n}\n\nfunc (s *S) F(a, b int, c ...string) (int, error) {\n\tif err := g(); err != nil {\n\t\treturn 0, err\n\t} else if a > b {\n\t}\n\tfor i, x := range y {\n\t\tdefer func() { z <- x }()\n\t}\n\tswitch v := q.(type) {\n\tcase int, string:\n\t\tw := []byte{1, 2}\n\tdefault:\n\t}\n\treturn len(s.A[1:2]), nil\n}\n"],
    "rust": ["use a::b::{c, d as e};\n#[derive(Debug)]\npub struct S<'a, T: Clone> { pub a: &'a str, b: Vec<T> }\nenum E { A, B(i32), C { x: u8 } }\nimpl<'a, T> Tr for S<'a, T> where T: X {\n    pub(crate) fn f(&mut self, x: Option<&str>) -> Result<(), Box<dyn Er>> {\n        let Some(y) = x else { return Ok(()) };\n        let v = z.iter().map(|&q| q + 1).collect::<Vec<_>>();\n        match y { 1 | 2 => g()?, n if n > 3 => { h() } _ => panic!(\"{}\", r#\"}\"#) }\n        for i in 0..10 { while let Some(k) = st.pop() { break; } }\n        if a { 'x' } else { b }\n    }\n}\n"],
}
BROKEN = {
    "python": ["def f(:\n", "if a:\nb\n", "x = 1\n  y = 2\n", "print 'a', b\n", "<<<<<<< HEAD\n", "try:\n    a\n", "a = (1\n", "if a:\n\tif b:\n\t\tc\n   \t\td\n", "please check this part\n", "x = \n", "\0", "print(“a”)\n"],
    "javascript": ["function f( { }", "const x = ;", "<<<<<<< HEAD\na()\n", "let x: number = 1;", "please check this part\n", "if (a &lt; b) {}", "<%= x %>", "if (a &amp;&amp; b) {}", "class A { m() { }", "try { a() }\n", "x = 'abc\n"],
    "typescript": ["func (s *S) F() {}", "interface I { a: ", "const x: = 1", ">>>>>>> x\n", "{% if x %}"],
    "c": ["int f( { return 1; }", "namespace a { }", "class A { public: int x; };", "int x = ;", "please check this part\nint y;", "=======\n", "int f() { return 1; "],
    "cpp": ["class A { int f() { };", "int x = = 1;", "def f(): pass", "if (a) { ) }", "/* open"],
    "csharp": ["class A { void F( { } }", "class A { int x = ; }", "fn main() -> i32 { 1 }", "<<<<<<< a\nclass A { }"],
    "go": ["package a\nfunc f( {\n}\n", "package a\nclass A:\n", "package a\nfunc f() {\n\tx := \n}\n", "import x from 'y'"],
    "rust": ["fn f( { }", "fn f() { let x = ; }", "def f(): pass", "fn f() { >>>>>>> a\n }", "fn f() -> { }"],
}


def _flag(lang, text):
    c = syntax.Checker(lang)
    k = c.lex(text)
    return c.problem(k) or sorted(c.pairs(k) - grammar.permissible_pairs(lang))


@pytest.mark.parametrize("lang", grammar.LANGUAGES)
def test_valid_texts(lang):
    for t in GOOD[lang]:
        assert not _flag(lang, t), (lang, _flag(lang, t))
        assert not _flag(lang, t.replace("\n", "\r\n"))


@pytest.mark.parametrize("lang", grammar.LANGUAGES)
def test_broken_texts(lang):
    for t in BROKEN[lang]:
        assert _flag(lang, t), (lang, t)


def test_every_cut_of_python_like_parser():
    import ast

    t = GOOD["python"][2]
    for i in range(len(t)):
        try:
            ast.parse(t[:i])
            ok = True
        except SyntaxError:
            ok = False
        assert bool(_flag("python", t[:i])) == (not ok), t[:i][-60:]


def test_unparsable_and_rates(spark, rows):
    f = spark.createDataFrame([(1, "r", "a.py", b"x = ("), (2, "r", "b.py", b""), (3, None, "c.h", b"int x;"), (4, "r", "d.txt", b"(("), (5, "r", "e.js", None), (6, "r", "f", b"fn f( {}")], "file_id BIGINT, repo STRING, path STRING, content BINARY")
    files = spark.createDataFrame([(6, " Rust ", "2024-01-01", None), (6, "unknown", "2024-01-02", None), (1, None, None, None), (2, "", None, None)], "file_id BIGINT, language STRING, analyzed_at STRING, ingested_at STRING")
    w = syntax.with_language(f, files)
    bad = syntax.unparsable(w)
    assert rows(bad.select("file_id", "lang")) == [(1, "python"), (6, "rust")]
    assert rows(syntax.rates(w, bad)) == [("r", "python", 2, 1, 0.5), ("r", "rust", 1, 1, 1.0), (None, "c", 1, 0, 0.0)]
    assert syntax.unparsable(w.limit(0)).count() == 0


def test_plan_fits_and_is_tight():
    r = random.Random(2)
    for cap in (10, 97, 256):
        h = {}
        for _ in range(400):
            k = min(cap, max(1, int(r.expovariate(4 / cap))))
            h[k] = h.get(k, 0) + r.choice([1, 1, 30])
        slots, n = packing.plan(h, cap)
        load = [0] * n
        got = {}
        for length, lo, hi, each, first in slots:
            for i in range(lo, hi):
                load[first + (i - lo) // each] += length
                got.setdefault(length, set()).add(i)
        assert all(0 < x <= cap for x in load) and {k: len(v) for k, v in got.items()} == h
        # no worse than best fit decreasing over single items
        items = sorted((k for k, c in h.items() for _ in range(c)), reverse=True)
        bins = []
        for x in items:
            fit = [b for b in bins if b + x <= cap]
            if fit:
                bins.remove(max(fit))
                bins.append(max(fit) + x)
            else:
                bins.append(x)
        assert n <= len(bins)


def test_pack(spark):
    r = random.Random(4)
    sizes = [(i % 90, r.choice([0, 5, 5, 5, r.randint(1, 40), 300])) for i in range(300)] + [(None, 7), (1, None)]
    df = spark.createDataFrame(sizes, "doc_id BIGINT, n_tokens BIGINT")
    for extra in (df, df.repartition(3)):
        p = packing.pack(extra, {1: 32, 2: 100}).collect()
        for s, cap in ((1, 32), (2, 100)):
            mine = [x for x in p if x.spec_id == s]
            load = {}
            for x in mine:
                load[x.container] = load.get(x.container, 0) + x.tokens
                assert x.tokens == cap or x.start % cap == 0
            assert max(load.values()) <= cap and sum(load.values()) == sum(n or 0 for _, n in sizes)
            assert len([x for x in mine if x.piece > 0]) == sum((-(-n // cap)) - 1 for _, n in sizes if n)
    assert packing.pack(df.limit(0), {1: 32}).count() == 0
    assert packing.fill(packing.pack(df, {1: 32})).first().fill > 0.9


def test_allocate_siblings_first():
    tree = {("a", "en", "x"): (1.0, 10.0), ("a", "en", "y"): (1.0, 1000.0), ("b", "en", "z"): (2.0, 1000.0)}
    got = mixing.allocate(tree, 400)
    assert [round(got[k]) for k in sorted(got)] == [10, 190, 200]
    tree[("a", "en", "y")] = (1.0, 20.0)
    assert [round(mixing.allocate(tree, 400)[k]) for k in sorted(tree)] == [10, 20, 370]
    assert sum(mixing.allocate(tree, 1e9).values()) == 1030


def test_mix(spark, rows):
    r = random.Random(6)
    docs = [(i, r.choice([" A", "a", "B", "c", None]), r.choice(["en", "EN-us", None]), r.choice([0, 3, 50, 7])) for i in range(900)]
    d = spark.createDataFrame(docs, "doc_id BIGINT, source STRING, lang STRING, n_tokens BIGINT")
    t = spark.createDataFrame([(1, "a", 1.0, 3, 0.4), (1, "b ", 3.0, 2, 0.4), (1, "nowhere", 1.0, 2, 0.4), (2, "c", None, 2, 1.0), (2, "b", 1.0, 0, 1.0), (3, "C", 2.0, 2, 5.0)], "mix_id INT, source STRING, target_weight DOUBLE, max_repeats INT, total_ratio DOUBLE")
    sel, shares = mixing.mix(d, t)
    s = {(x.mix_id, x.source): x for x in shares.collect()}
    total = sum(n for *_, n in docs)
    assert abs(s[1, "a"].actual_share - 0.25) < 0.02 and abs(s[1, "a"].tokens + s[1, "b"].tokens - 0.4 * total) < 200
    assert s[1, "nowhere"].tokens == 0 and s[2, "b"].tokens == 0 and s[2, "c"].tokens == 0
    have = sum(n for _, x, _, n in docs if x == "c")
    assert s[3, "c"].tokens == 2 * have and s[3, "c"].most_repeats == 2  # all there is, as often as allowed
    assert rows(sel) == rows(mixing.mix(d.repartition(5), t)[0])
    assert sel.where("repeats > 3").count() == 0
    assert mixing.mix(d.limit(0), t)[1].count() == 6


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "wort " * 20000)], "doc_id BIGINT, text STRING")
    n = {r.doc_id: r.n_tokens for r in tokens.with_tokens(df).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1 and n[5] >= 20000


COMMON = ["the", "a", "of", "to", "and", "is", "in", "that", "it", "for", "on", "was", "der", "die", "und", "ist", "nicht"]
PROSE = "The parser reads the file and then it is written to the disk, so that nobody has to wait for the result of it."


@pytest.mark.parametrize(
    "text,prose",
    [
        (PROSE, True), (PROSE.lower().replace(",", "").replace(".", ""), True), ("> " + PROSE, True), ("# Head\n\n" + PROSE + "\n\n```\nint x;\n```\n", True), ("Der Index ist nicht leer und die Suche ist schnell.", True),
        ("設定を変えると、検索機能が木全体を読み込むことがあります。", True), (PROSE + "\n\n- one\n- two\n", True),
        ("- " + PROSE + "\n- " + PROSE, False), ("1. Fix a\n2. Drop b\n", False), ("| a | b |\n|---|---|\n| 1 | 2 |\n", False), ("a,b,c\n1,2,3\n4,5,6", False), ('{"a": 1, "b": [1, 2]}', False),
        ("2024-01-01T10:00:00Z INFO the start of it\n2024-01-01T10:00:01Z WARN that is it", False), ("def f(a):\n    return a + 1\n", False), ("span >> span >> span >> span", False), ("bucket. " * 40, False),
        ("aGVsbG8gd29ybGQ/aGVsbG8+d29ybGQaGVsbG8", False), ("x" * 100000, False), ("the the the the the " * 30, False), ("ã\x81\x82ã\x81\x84ã\x81\x86ã\x81\x88", False),
    ],
)
def test_prose(text, prose):
    f = quality.figures(text, frozenset(COMMON))
    assert f["is_prose"] == prose and not f["is_blank"]


def test_statistics(spark, rows):
    d = spark.createDataFrame([(1, "A b.\n\nA b.\nx y z w", 7), (2, None, 7), (3, " \n ", 7)], "doc_id BIGINT, text STRING, n_words INT")
    w = spark.createDataFrame([("en", "A"), ("en", None)], "lang STRING, word STRING")
    x = {r.doc_id: r for r in quality.statistics(d, w).collect()}
    assert (x[1].n_words, x[1].n_lines, x[1].n_paragraphs) == (8, 3, 2) and x[1].common_words == 0.25 and abs(x[1].punctuated_lines - 2 / 3) < 1e-9 and abs(x[1].duplicate_lines - 8 / 15) < 1e-9
    assert x[2].is_blank and x[3].is_blank and rows(quality.not_prose(quality.statistics(d.where("doc_id > 1"), w))) == []
    assert quality.statistics(d.limit(0), w.limit(0)).count() == 0
    assert quality.ngram_cover("a b a b a b".split(), 2) == 1.0 and quality.ngram_cover("a b c d".split(), 2) == 0


def test_repetition_decides():
    fig = lambda t: quality.figures(t, frozenset(COMMON))
    one = fig(PROSE + "\n\n" + "And so that is it for the day.")
    many = fig("\n\n".join([PROSE] * 40))
    assert one["is_prose"] and one["boilerplate_share"] == 0 and not many["is_prose"] and many["boilerplate_share"] > 0.9 and many["duplicate_paragraphs"] == 1
    lines = fig("\n".join([PROSE, "Menu of the site", "that is for you"] * 9))
    assert not lines["is_prose"] and lines["duplicate_lines"] == 1 and lines["boilerplate_share"] > 0.8
    assert fig(f"> {PROSE}\n\n{PROSE}")["is_prose"]  # a quotation and what it quotes
    assert quality.ngram_cover("a a a a".split(), 2) == 1.0 and quality.ngram_cover("a b a b x".split(), 2) == 0.8 and quality.ngram_cover("a a a b".split(), 2) == 0


def test_indented_lines_behind_items():
    t = "The item two is in the list.\n\n- first\n  item two\n"
    assert abs(quality.figures(t, frozenset(COMMON))["list_share"] - 13 / 35) < 1e-9


def test_covers_like_brute_force():
    r = random.Random(3)
    texts = [[r.choice(["a", "bb", "ccc", "d"]) for _ in range(r.randint(0, 14))] for _ in range(60)]
    num = {"a": 0, "bb": 1, "ccc": 2, "d": 3}
    import numpy as np

    got = quality.covers([(np.array([num[w] for w in t], int), np.array([len(w) for w in t], int)) for t in texts])
    for t, g in zip(texts, got):
        for n in (2, 3, 4):
            best = 0
            for gram in {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}:
                c, i = 0, 0
                while i + n <= len(t):
                    hit = tuple(t[i : i + n]) == gram
                    c, i = c + hit, i + (n if hit else 1)
                best = max(best, c * sum(map(len, gram)) if c > 1 else 0)
            assert abs(g[n - 2] - (best / sum(map(len, t)) if t else 0)) < 1e-9


def test_says():
    for t in ("// Code generated by x v1. DO NOT EDIT.\nint a;", "/*\n * @generated\n */\nint a;", "/*! lib v1.2.3 */\nx()", "x()\n//# sourceMappingURL=a.map\n", '"""@generated by y"""\nx = 1\n'):
        assert provenance.says(t)[0], t
    for t in ("// templates print \"DO NOT EDIT\" on top\nint a;", "int a;\n// Code generated by x\n", ""):
        assert not provenance.says(t)[0], t
    assert provenance.says("# kit 1.2.3 - upstream copy, do not change here\nx = 1")[1:] == (True, "x = 1")
    assert provenance.marked("a/node_modules/b/c.js")[1] and provenance.marked("x/y.g.cs")[0] and not any(provenance.marked("src/third_party_check.cc")) and not any(provenance.marked("src/min/generated_names.go"))


def test_held_out_files(spark):
    r = random.Random(9)
    w = lambda: r.choice("alpha beta gamma delta epsilon zeta theta kappa lambda".split())
    hand = lambda: "".join(f"def {w()}_{w()}({w()}):\n    # about the {w()}\n    {w()} = {w()}.{w()}({w()})\n    if {w()} > {r.randint(1, 99)}:\n        return {w()}\n\n" for _ in range(r.randint(3, 12)))
    gen = lambda: "".join(f"    def get_{w()}{i}(self):\n        return self._f[{i}]\n" for i in range(r.randint(10, 40)))
    lib = hand() * 2
    rows, truth = [], {}
    for i in range(240):
        k = i % 4
        text = hand() if k < 2 else ("# Code generated by x v1. DO NOT EDIT.\n" if k == 2 else "") + gen()
        rows.append((i, f"src/f{i}.py", text.encode()))
        truth[i] = k >= 2
    rows += [(900, "src/copy.py", lib.encode()), (901, "vendor/kit/x.py", hand().encode()), (902, None, None), (903, "e.py", b"")]
    f = spark.createDataFrame(rows, "file_id BIGINT, path STRING, content BINARY")
    found = {x[0] for x in provenance.not_hand_written(provenance.scored(f, spark.createDataFrame([(lib,), (None,)], "content STRING"))).collect()}
    silent = [i for i in truth if i % 4 == 3]
    assert sum(i in found for i in silent) >= 0.8 * len(silent)
    assert sum(i in found for i in truth if not truth[i]) <= 0.05 * 120
    assert {900, 901} <= found and not {902, 903} & found
    assert provenance.scored(f.limit(0), spark.createDataFrame([], "content STRING")).count() == 0
    # more shingles than are sent: the same shares by a join
    lib_df = spark.createDataFrame([(lib,), (None,)], "content STRING")
    figures = lambda most: {x.file_id: [round(v, 9) for v in x.features] for x in provenance.described(f, lib_df, most).collect()}
    assert figures(0) == figures(10**6)
    at = provenance.FEATURES.index("known_shingles")
    brute = lambda t: {tuple(w[i : i + 5]) for w in [provenance._IDENT.findall(t)] for i in range(len(w) - 4)}
    have = figures(10**6)
    for i, _, content in rows:
        s = brute(provenance.says((content or b"").decode())[2])
        assert abs(have[i][at] - (len(s & brute(lib)) / len(s) if s else 0)) < 1e-9
