import re
import time

from pyspark.sql import functions as F

from helixbag.llm import secret_scan as S

WORDS = ["password", "Passwd", "secret", "TOKEN", "api_key", "apikey"]
TEXTS = [
    None, "", "plain prose: nothing = here", 'token = "ffc3105535f423f352535e4ac53b5fefe076ac6d" end',
    "password:abc password: abcdef PASSWORD='x.y=z/1'", "ſecret = abcdefgh toKen = abcdefgh", "AKIA" + "A" * 15,
    "xAKIA" + "Z9" * 8 + "a", "ab" * 12 + "g" + "0" * 23, "secret==abc, token = = x" + "é😀" * 3 + "api-key: abcdefg api_key:abcdefg",
    "token: secret = abcdefgh " * 200,
]


def brute(text):
    text = text or ""
    words = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
                     for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
    assign = [m for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    access = [m for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    hexes = [m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = sorted((m.start(), k, m.end()) for k, ms in enumerate((assign, access, hexes)) for m in ms)
    return len(assign), len(access), len(hexes), S.written(spans)


def test_base_equals_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_spans) for r in S.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def lexed(text):
    return [text[a:b] for a, _, b in S.lexed_spans(text)]


def test_lexer_follows_constants_and_concatenation():
    assert lexed('part = "kQ8zR2"\nother = part + "vLw94Tz"\ndb_password = other\n') == ["kQ8zR2", "vLw94Tz"]
    assert lexed("clientSecret: 'Zk83hsLQ02xx'") == ["Zk83hsLQ02xx"]
    assert lexed('{"private-key": "Qm93hsKK02xyPl"}') == ["Qm93hsKK02xyPl"]
    assert lexed("colour = 'Zk83hsLQ02xx'") == []
    assert lexed('password = "changeme"') == [] and lexed("the token: of thanks") == []
    assert lexed("x = 1; y := 2; note => 3; password") == []


def test_lexer_reads_many_kinds_of_syntax():
    secret = "Zk3!pQ9v_Lm2"
    for text in (f"const a: string = '{secret}';\npassword = a", f'password = decode(x, "{secret}")', f'setPassword("{secret}")',
                 f'put("db_password", "{secret}")', f"connect(user='me', password='{secret}')", f'password = """{secret}"""',
                 f"<db><password>{secret}</password></db>", f"password: |\n  {secret}\nother: 1", f"  password: >-\n    {secret}\n  other: 1",
                 f"password: Optional[str] = b'{secret}'", f'it\'s config["password"] = "{secret}" isn\'t it', f'{{"password": "{secret}"}}'):
        assert lexed(text) == [secret], text
    assert lexed("pwd = os.environ.get('DB_PASSWORD')\npassword = config.db.password") == []
    assert lexed(f"password: |\nother: {secret}") == []


def test_long_names_chains_and_runs_take_linear_time():
    begin = time.time()
    assert lexed("password_" + "a" * 10_000 + ' = "Zk3!pQ9v_Lm2"') == ["Zk3!pQ9v_Lm2"]
    doubled = 'a0 = "Zk3!pQ9v"\n' + "".join(f"a{i} = a{i - 1} + a{i - 1}\n" for i in range(1, 10_000)) + "password = a9999"
    assert lexed(doubled) == ["Zk3!pQ9v"]
    added = 'a0 = "Zk3!pQ9v"\n' + "".join(f'a{i} = a{i - 1} + "{i}"\npassword_{i} = a{i}\n' for i in range(1, 10_000))
    assert len(lexed(added)) == 10_000
    for run in ("key" * 300_000, "a=f(" * 100_000 + "key", "<key" * 100_000, '"""key' * 100_001, "key: |\n" * 50_000, "key = 'x" * 50_000):
        lexed(run)
    assert time.time() - begin < 30


def test_redaction_findings_and_odd_tables(spark):
    text = 'a token = "ffc3105535f423f352535e4ac53b5fefe076ac6d" b'
    docs = spark.createDataFrame([(1, text, 5), (1, text, 5), (None, None, None)], "doc_id long, text string, kind int")
    assert sorted(str(r.text) for r in S.redact(docs).collect()) == ["None", 'a [SECRET]" b', 'a [SECRET]" b']
    assert S.redact(docs).columns == docs.columns
    assert {(r.kind, r.start, r.end) for r in S.findings(docs).collect()} == {("assign", 2, 51), ("hex", 11, 51), ("lexed", 11, 51)}
    assert S.scan(docs.limit(0)).count() == 0
