import uuid

from pyspark.sql import functions as F

from silverloom.functions import identifiers as I
from silverloom.functions.extraction import embed, entities_of, relations_of
from silverloom.functions.text import fold, index_tokens, nfc, nfc_all


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr).first()[0] if values else spark.range(1).select(expr).first()[0]


def tokens(spark, text):
    return set(one(spark, I.query_tokens(F.lit(text))))


def test_query_tokens(spark):
    assert tokens(spark, "how to hash a password") == {"hash", "password"}
    assert tokens(spark, "what is the OAuth flow") == {"oauth", "flow"}
    assert tokens(spark, "HashPassword") == {"hash", "password"}
    assert tokens(spark, "getUserById") == {"get", "user"}
    assert tokens(spark, "what is it") == set() and tokens(spark, "") == set()


def path(spark, p, q):
    return one(spark, I.path_overlap(F.lit(p), I.query_tokens(F.lit(q))))


def test_path_overlap(spark):
    assert path(spark, "/src/components/UserProfile.tsx", "user profile") == 2
    assert path(spark, "/lib/SHA256Hash.go", "sha256 hash") == 3
    assert path(spark, "/src/authentication/handler.go", "auth") == 1
    assert path(spark, "/src/lauth.go", "auth") == 0
    for p in ("/Users/alice/a.go", "/home/alice/a.go", "C:\\Users\\alice\\a.go"):
        assert path(spark, p, "alice") == 0
    assert path(spark, "/a/alice/b/c/d/e.go", "alice") == 0


def test_entity_overlap(spark):
    for name, q, n in (("HTMLParser", "html parser", 2), ("GetHTTPServer", "get http server", 3), ("SHA256Hash", "sha 256 hash", 3), ("Base64", "base 64", 1), ("version2024Patch", "version 2024 patch", 3)):
        assert one(spark, I.entity_overlap(F.array(F.lit(name)), I.query_tokens(F.lit(q)))) == n


def test_ids(spark):
    key = "m:p:/a/\u00e9.go:f:3"
    assert one(spark, I.uuid5_url(F.lit(key))) == str(uuid.uuid5(uuid.NAMESPACE_URL, key))
    n = lambda *a: one(spark, I.node_id(*[F.lit(x).cast("string") for x in a]))
    assert [n("m", "/a", "f"), n("", "/a", "f"), n("m", "/a", None), n("m", "", "x"), n(None, None, "x"), n("m", None, None)] == ["m:/a#f", "/a#f", "m:/a", "m:x", "x", ""]


def test_text(spark):
    assert one(spark, nfc(F.lit("cafe\u0301"))) == "caf\u00e9" and one(spark, nfc(F.lit(""))) == "" and one(spark, nfc(F.lit(None).cast("string"))) is None
    assert one(spark, nfc_all(F.array(F.lit("e\u0301"), F.lit(None), F.lit("a")))) == ["\u00e9", None, "a"]
    assert one(spark, fold(F.lit("\u00c9t\u00c9 \u0141"))) == "ete \u0142"
    assert one(spark, index_tokens(F.lit("a_b-C2 d\u00e9j\u00e0"))) == ["a", "b", "c2", "deja"]


GO = 'package main\n\nimport "fmt"\n\ntype Runner struct {\n\tx int\n}\n\nfunc (r *Runner) Run() {\n\tfmt.Println("x")\n\thelper()\n}\n\nfunc helper() {\n}\n\nfunc main() {\n\thelper()\n}\n'


def test_extraction():
    assert [(n, k) for n, k, _, _ in entities_of("/a.go", GO)] == [("Runner", "type"), ("Runner.Run", "function"), ("helper", "function"), ("main", "function")]
    rel = {(t, s, x) for t, s, x, _, _ in relations_of("/a.go", GO)}
    assert {("IMPORTS", None, "fmt"), ("CALLS_SYNTAX", "Runner.Run", "fmt.Println"), ("CALLS_SYNTAX", "Runner.Run", "helper"), ("CALLS_SYNTAX", "main", "helper"), ("CONTAINS", None, "main")} <= rel
    assert entities_of("/a.py", "class A:\n    def f(self):\n        pass\n\nasync def g(): ...\n") == [("A", "class", 1, 3), ("f", "function", 2, 3), ("g", "function", 5, 5)]
    assert entities_of("/a.py", "def (") == [] and entities_of("/a.txt", "x") == [] and entities_of("", "") == []
    ts = "export interface I {\n  a: string;\n}\nexport class C {\n  async m(x: number): Promise<void> {\n    if (x) {\n    }\n  }\n}\nfunction f() {}\n"
    assert entities_of("/a.TSX", ts) == [("I", "interface", 1, 3), ("C", "class", 4, 9), ("m", "method", 5, 8), ("f", "function", 10, 10)]


def test_embedder():
    v = embed("getUser user")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and embed("") == [0.0] * 64 and embed("a b") == embed("a b")
