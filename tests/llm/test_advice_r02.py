
import random

from tests.llm.conftest import prose
from tidewatch.llm import quality, secrets
from tidewatch.session import shared_dir


def test_small_languages_are_judged_by_their_own_documents(spark):
    rng = random.Random(12)
    many = [(i, prose(rng, "en", rng.randint(40, 120)), "en") for i in range(300)]
    few = [(1000 + i, " ".join("zwq" + w[::-1] for w in prose(rng, "es", rng.randint(40, 120)).split()), "es") for i in range(90)]
    junk = [(2000 + i, " ".join(w + "$$$" for w in prose(rng, "es", 60).split()), "es") for i in range(20)]
    alone = [(3000 + i, "ŋqx " * rng.randint(10, 90), "xx") for i in range(10)] + [(3100, "", "xx")]
    docs = spark.createDataFrame(many + few + junk + alone, "doc_id long, text string, lang string").repartition(3)
    trusted = [(i, 1, 0) for i, _, _ in many[:250] + few[:20]]  # 20 of es, none of xx
    judge = quality.Classifier(docs, spark.createDataFrame(trusted, "doc_id long, quality int, toxic int"))
    keep = {r.doc_id: r.keep for r in judge.judged().collect()}
    assert set(judge.limits) == {"en", "es"}
    assert sum(keep[i] for i, _, _ in few) >= 88
    assert not any(keep[i] for i, _, _ in junk)
    assert all(keep[i] for i, t, _ in alone if t) and not keep[3100]
    assert {r.doc_id for r in judge.kept(docs).collect()} == {i for i, k in keep.items() if k}


def test_private_keys_are_masked_with_their_bodies(spark):
    rng = random.Random(13)
    lines = ["".join(rng.choices("ABCDefgh0123456789+/", k=64)) for _ in range(6)] + ["c2hvcnQ="]
    body, head, end = "\n".join(lines), "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    info = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    cases = [(f"a {head}\n{body}\n{end} b", "a [secret] b"),
             (f"a\n{head}\n{info}{body}\n{end}\nb", "a\n[secret]\nb"),
             (f"a {head}\n{body}\nplain prose follows", "a [secret]\nplain prose follows"),
             (f"a {head}\n{info}{body}", "a [secret]"),
             ("k = \"" + f"{head}\n{body}\n{end}\n".replace("\n", "\\n") + "\"", "k = \"[secret]\\n\""),
             (f"{head}\n{body}\nbetween the keys {head}\n{body}\n{end}", "[secret]\nbetween the keys [secret]"),
             (f"the line {head} alone", "the line [secret] alone")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    ledger = shared_dir(spark, "ledger")
    secrets.update_ledger(docs, ledger, secrets.RULES)  # blobs that the old version has seen are scanned again
    out = {r.doc_id: r.text for r in secrets.redact(docs, ledger).collect()}
    assert out == {i: t for i, (_, t) in enumerate(cases)}
    assert not any(line in t for line in lines for t in out.values())
