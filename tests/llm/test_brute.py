"""Operators against brute force, exact round trips and held-out accuracy."""

import glob
import hashlib
import os
import random
import re
import shutil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontaminate, jaccard, media, secrets_scan, suffix_dedup, token_store, toxicity, warc
from lattica.llm.common import blocks, shared_dir
from lattica.llm.components import components
from lattica.llm.shingles import shingles
from tests.llm.test_whole import groups_brute

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def planted(spark, copies=90):
    """Documents with near copies of one of them, as many as make long posting lists, and passages in common."""
    r = random.Random(5)
    base = " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=400))
    base = " ".join(f"w{r.randint(0, 400)}" for _ in range(300))
    rows = texts(spark)[:60]
    for k in range(copies):
        words = base.split()
        for _ in range(r.randint(0, 9)):
            words[r.randrange(300)] = f"v{r.randint(0, 10**6)}"
        rows.append((1000 + k, " ".join(words)))
    rows.append((2000, "x" + base[:700] + "y"))
    return rows


def removed_brute(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out[doc_id] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 6])
def test_suffix(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 10**9)
    rows = planted(spark)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == removed_brute(rows)


def test_interval_tree():
    lcp = [1, 3, 3, 0, 2]
    found = {(d, a, b) for d, a, b, _ in suffix_dedup._Tree.intervals(lcp) if b > a}
    assert found == {(0, 0, 5), (1, 0, 3), (3, 1, 3), (2, 4, 5)}


def components_brute(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.lower())
        sets[i] = frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    ids, label = sorted(sets), {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                p, q = root(ids[a]), root(ids[b])
                label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("long", [64, 4])
def test_jaccard(spark, monkeypatch, long):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rows = planted(spark)
    got = jaccard.near_duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_brute(rows)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    label = {}
    for a, b in edges:
        for x in (a, b):
            label.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    alone = {x for x in label if all(a == b for a, b in edges if x in (a, b))}
    assert got == {k: v for k, v in label.items() if k not in alone}


def test_shingles_agree():
    rows = ["One two THREE four", "one TWO three four", "one two", "", "a  b\tc\nd e"]
    column = pa.array(rows)
    from lattica.llm.common import text_bytes

    value, cut = shingles(*text_bytes(column), 3)
    parts = [value[cut[k] : cut[k + 1]].tolist() for k in range(len(rows))]
    assert parts[0] == parts[1] and [len(p) for p in parts] == [2, 2, 1, 0, 3]
    long = " ".join(["word"] * 60000)
    assert len(set(shingles(*text_bytes(pa.array([long])), 3)[0].tolist())) == 1


def test_blocks_keep_rows():
    column = pa.array(["x" * n for n in (0, 5, 3, 100, 1, 1, 1, 7)])
    batches = [pa.RecordBatch.from_arrays([column.slice(k, 3)], ["text"]) for k in range(0, 8, 3)]
    assert [t for b in blocks(iter(batches), "text", 8) for t in b.column(0).to_pylist()] == column.to_pylist()


def test_edit_distance():
    def plain(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, t in enumerate(text, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != t)))
            row = new
        return min(row)

    r = random.Random(4)
    for _ in range(60):
        item, text = (bytes(r.choices(b"abc", k=r.randint(1, n))) for n in (90, 120))
        assert decontaminate.best_edits(item, text)[0] == plain(item, text)


def test_decontamination_recall(spark):
    r, items = random.Random(8), [(x.item_id, x.text) for x in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = [t for _, t in texts(spark) if not any(decontaminate.normal(i) in decontaminate.normal(t) for _, i in items)]
    docs, truth = [(10_000 + k, t) for k, t in enumerate(clean)], set()
    for k in range(120):
        item, passage = r.choice(items)
        letters = list(passage)
        for _ in range(int(0.05 * len(letters))):
            at = r.randrange(len(letters))
            letters[at] = r.choice(["", "q", letters[at] + "z"])
        host = r.choice(clean)
        planted = "".join(letters)
        docs.append((k, host[:150] + "\n" + (planted.upper() if planted.isascii() else planted) + "  " + host[150:400]))
    known = [(i, decontaminate.normal(t)) for i, t in items]
    for k, t in docs:
        if k < 40 or 10_000 <= k < 10_040:
            truth |= {(k, i) for i, p in known if decontaminate.best_edits(p, decontaminate.normal(t))[0] <= decontaminate.allowed(len(p))}
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(x.doc_id, x.item_id) for x in found}
    assert len(truth & got) >= 0.9 * len(truth) and len(truth) >= 35
    assert not {d for d, _ in got if d >= 10_000} - {d for d, _ in truth}


def test_encoder_is_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = token_store.tokenizer_path()
    own, theirs = token_store.Encoder(path), Tokenizer.from_file(path)
    rows = [t for _, t in texts(spark)] + ["a  b\n\n c <|endoftext|> d\t e ", "", " x", "it's  I'll go　x \n y", "x \x1c y\x00 a", "1234 5,6. \n\nA.B, ü!? don't\n"]
    ids, offsets = own.encode(rows)
    for k, t in enumerate(rows):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == theirs.encode(t, add_special_tokens=False).ids + [token_store.END_ID]


def test_store_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000))
    folder = shared_dir(spark, "store")
    token_store.write_store(docs, folder)
    rows = token_store.read_store(spark, folder, keep_ids=True).collect()
    own = token_store.Encoder(token_store.tokenizer_path())
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    start = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        assert r.start == start and r.ids == own.encode([text[r.doc_id]])[0].tolist()
        start += r.n_tokens
    index = spark.read.parquet(f"{folder}/index")
    assert index.count() == index.select("name").distinct().count()
    assert index.agg(F.sum("size")).first()[0] < 0.6 * 2 * start, "copies are stored once"
    parts = spark.read.parquet(f"{folder}/recipes").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("start", "root"))).alias("r"))
    manifest = {m.part: bytes(m.root) for m in spark.read.parquet(f"{folder}/manifest").collect()}
    assert manifest.pop(-1) == token_store.merkle([manifest[p] for p in sorted(manifest)])
    assert manifest == {p.part: token_store.merkle([bytes(x.root) for x in p.r]) for p in parts.collect()}


@pytest.mark.parametrize("harm", ["pack", "recipe", "manifest", "no manifest", "index", "nothing"])
def test_store_says_what_is_wrong(spark, harm):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 40")
    folder = shared_dir(spark, "store")
    token_store.write_store(docs, folder)
    home = folder.removeprefix("file:")
    if harm == "pack":
        for name in glob.glob(f"{home}/packs/*.pack"):
            data = bytearray(open(name, "rb").read())
            data[len(data) // 2] ^= 255
            open(name, "wb").write(data)
    elif harm == "no manifest":
        shutil.rmtree(f"{home}/manifest")
    elif harm != "nothing":
        table = {"recipe": "recipes", "manifest": "manifest", "index": "index"}[harm]
        rows = spark.read.parquet(f"{folder}/{table}").toArrow()
        if harm == "recipe":
            rows = rows.slice(1)
        elif harm == "manifest":
            rows = rows.set_column(rows.schema.get_field_index("root"), "root", pa.array([bytes(16)] * len(rows), pa.binary()))
        else:
            rows = rows.slice(0, len(rows) // 2)
        shutil.rmtree(f"{home}/{table}")
        os.makedirs(f"{home}/{table}")
        pq.write_table(rows, f"{home}/{table}/part.parquet")
    if harm == "nothing":
        assert token_store.read_store(spark, folder).count() == docs.count()
    else:
        with pytest.raises(Exception, match="manifest|chunk|recipe|PATH_NOT_FOUND|decompress|zstd|corrupt"):
            token_store.read_store(spark, folder).collect()


def test_media_classes_and_cut_files(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=6000).cumsum() * 50
    whole = media.encode(x)
    for cut in [*range(0, 60), *range(len(whole) - 9, len(whole))]:
        rate, samples = media.decode(whole[:cut])
        assert len(samples) <= len(x) and media.fingerprint(media.chroma(samples, rate)) is not None
    for bad in (b"RIFF\xff\xff\xff\xffWAVEfmt \x02\x00\x00\x00\x01\x00", whole[:20] + bytes(24) + whole[44:], whole.replace(b"data", b"date")):
        assert len(media.decode(bad)[1]) == 0
    # one id, two sounds: two classes
    tunes = [[float(k % 7) for k in range(64)], [float(k * k % 11) for k in range(64)]]
    rows = [(100, tunes[0]), (101, tunes[0]), (100, tunes[1]), (102, tunes[1])]
    folder = shared_dir(spark, "in").removeprefix("file:")
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"file:{folder}/embeddings.parquet")
    got = [(r.vec_id, r.class_key) for r in media.op10_media(spark, f"file:{folder}").where("kind = 'member'").collect()]
    assert len(got) == 4 and len({k for _, k in got}) == 2 and {len({k for i, k in got if i in pair}) for pair in ((101,), (102,))} == {1}
    assert {k for i, k in got if i == 101} != {k for i, k in got if i == 102}


def test_short_recordings_match(spark):
    rows = [(0, [float(k * 7 % 5) for k in range(14)]), (1, [float(k * 7 % 5) for k in range(14)] + [0.5] * 20)]
    prints = media.fingerprints(media.tunes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))).select(F.col("id").alias("class"), "print", "frames")
    least = prints.agg(F.min("frames")).first()[0]
    assert media.LEAST_FRAMES <= least < media.LEAST_OVERLAP
    found = media.search(prints, prints.where("class = 0").select("class")).collect()
    assert [(r["class"], r.match) for r in found] in ([], [(0, 1)]) and all(r.overlap >= least for r in found)


def test_items_anywhere_in_words(spark):
    """Items glued behind letters, in the middle of words, long ones, and recall of edited ones there."""
    r = random.Random(31)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    items = [(k, prose(r.randint(12, 40))) for k in range(20)]
    docs = [(k, f"{prose(20)} {'x' * (k % 17)}{t}{'y' * (k % 5)} {prose(20)}") for k, t in items]
    docs += [(100 + k, prose(60)) for k in range(20)]
    for k, t in items:
        edited = list(t)
        for _ in range(int(0.03 * len(t))):
            edited[r.randrange(len(edited))] = "q"
        docs.append((200 + k, f"{prose(9)} {'z' * (1 + k % 12)}{''.join(edited)} {prose(9)}"))
    items.append((99, prose(8_000)))
    docs.append((99, f"{prose(5)} ab{items[-1][1]} {prose(5)}"))
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {(k, k) for k in range(20)} | {(99, 99)} <= got
    assert not {d for d, _ in got if 100 <= d < 200}
    assert len({(200 + k, k) for k in range(20)} & got) >= 18


def test_warc_splits(spark):
    r = random.Random(6)
    rows = [(k, f"http://x/{k}", "".join(r.choices("ab\x1f é", k=r.randint(0, 4000)))) for k in range(80)]
    files = warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2), shared_dir(spark, "warc"))
    for size in (257, 4096, 1 << 22):
        got = {x.page_id: (x.payload, x.payload_digest) for x in warc.read_warc(files, size).collect()}
        assert got == {k: (h, hashlib.sha256(h.encode()).hexdigest()) for k, _, h in rows}


def test_toxicity_fits_on_bounded_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(k, f"other {k}") for k in range(2, 40)], "doc_id bigint, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id bigint, label int")
    assert toxicity._within(docs, known, 338) is known
    for most, left in ((337, 38), (38, 38), (10, 10)):
        within = toxicity._within(docs, known, most)
        assert within.where("doc_id = 1").isEmpty() and within.count() == left
        assert docs.join(within, "doc_id").count() <= most


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    rows = got.select("toxic", "predicted").collect()
    assert len(rows) > 500
    assert np.mean([r.toxic == r.predicted for r in rows]) > 0.94
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


def test_secrets_held_out(spark):
    from pyspark.ml.functions import array_to_vector

    none = np.zeros(0, np.uint64)
    model = secrets_scan.train(spark)
    rows = secrets_scan.made_findings(600, seed=99)
    data = spark.createDataFrame([(secrets_scan.features(*r[:4], none), float(r[4])) for r in rows], "numbers array<double>, label double")
    out = model.transform(data.select(array_to_vector("numbers").alias("features"), "label")).select("label", "prediction").collect()
    assert np.mean([r.label == r.prediction for r in out]) > 0.97


def test_planted_secrets_are_found(spark):
    """Recall on the keys in documents, of whose form no made finding is; and what is no secret there."""
    d = "/root/testdata/sf0.1"
    form = re.compile(r'token = "([0-9a-f]{40})"')
    assert not any(form.search(f"{b}{t}{a}") for b, t, a, _, _ in secrets_scan.made_findings(3000))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    planted = {(r.doc_id, hashlib.sha256(v.encode()).hexdigest()) for r in docs.where("text rlike 'token = \"[0-9a-f]{40}\"'").collect() for v in form.findall(r.text)}
    got = secrets_scan.op6_secrets_scan(spark, d).collect()
    named = {(r.doc_id, r.candidate_sha256) for r in got if r.is_secret}
    assert len(planted) > 50 and len(planted & named) >= 0.9 * len(planted)
    assert len(named - planted) <= len(planted), "few others"


def test_findings_table_decides(spark):
    docs = spark.createDataFrame([(1, "the badge ZX-1234-5678-QQ hangs here", "a.txt"), (2, "sha 0123456789abcdef0123 there", "a.txt")], "doc_id bigint, text string, source string")
    r = random.Random(3)
    rows = [("the badge ", f"ZX-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}-QQ", " hangs", "x", 1) for _ in range(60)]
    rows += [("sha ", "%020x" % r.getrandbits(80), " there", None, 0) for _ in range(60)] + [("", "odd", "", "", None)]
    findings = spark.createDataFrame(rows, "before string, candidate string, after string, path string, label int").withColumn("numbers", F.lit(1))
    assert {x.doc_id: x.is_secret for x in secrets_scan.scan(docs, findings).collect()} == {1: 1, 2: 0}


def test_candidates_brute(spark):
    """Candidates by plain regular expressions."""
    r = random.Random(41)
    pieces = ["password=", "x", " ", "Ab1", "sk-", "token: ", '"', "'", "q9", "99", "Zz", "+/", "é", "\n", "AKIA", "secret = ", "bearer ", "abcDEFghiJKLmnop", "key", "&", ";", "(", ")", "1234567890", "-", "_"]
    rows = [(k, "".join(r.choices(pieces, k=r.randint(0, 30))), None) for k in range(300)]
    run, forms = re.compile(rb"[A-Za-z0-9+/_-]+"), tuple(f.encode() for f in secrets_scan._FORMS)
    word = b"(?:" + b"|".join(w.encode() for w in sorted(secrets_scan.SECRET_WORDS, key=len, reverse=True)) + b")"
    want = set()
    for k, text, _ in rows:
        data = text.encode()
        for m in run.finditer(data):
            v = m[0]
            digits, mixed = sum(c in b"0123456789" for c in v), any(65 <= c <= 90 for c in v) and any(97 <= c <= 122 for c in v)
            if len(v) >= secrets_scan.LEAST and digits >= 2 or len(v) >= secrets_scan.LEAST_MIXED and mixed or v.startswith(forms):
                want.add((k, m.start(), len(v)))
        for at in range(len(data)):
            low = data[at:].lower()
            name = word + rb"[a-z0-9_.-]{0,40}"
            quoted, bare = [rb'"([^"\r\n]+)"', rb"'([^'\r\n]+)'"], rb"""["']?([^\s"']\S*)"""
            said = name + rb"""["'\]]{0,2}[ \t]{0,8}(?:=>|[:=]{1,3})[ \t]{0,8}"""
            ways = [(said, q, False) for q in quoted] + [(said, bare, True), (rb"bearer[ \t]{1,8}", rb"(\S+)", True)] + [(name + rb"[ \t(]{1,8}", q, False) for q in quoted]
            for head, value, loose in ways:  # the first way that fits
                if m := re.match(head + value, low):
                    begin, end = at + m.start(1), at + m.end(1)
                    want.add((k, begin, end - begin))
                    if loose:
                        v = data[begin:end]
                        want |= {(k, begin, len(x)) for x in (v.rstrip(b".,;:)]}>\"'"), re.split(rb"[&,;\"']", v)[0]) if x}
                    break
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {(x.doc_id, x.begin, x.length) for x in secrets_scan.candidates(docs).collect()}
    assert got == want


def test_long_candidate(spark):
    blob = "QWxhZGRpbjpv" * 90_000
    docs = spark.createDataFrame([(1, f"data {blob} end", "a")], "doc_id bigint, text string, source string")
    assert [(x.begin, x.length) for x in secrets_scan.scan(docs).collect()] == [(5, len(blob))]


def test_score_brute(spark):
    """Scores from plain sets of character n-grams and the model's weights."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    weight = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for doc_id, text in texts(spark)[:60]:
        data, own = [c + 32 if 65 <= c <= 90 else c for c in text.encode()], set()
        for order in toxicity.ORDERS:
            for at in range(len(data) - order + 1):
                value = 0
                for c in data[at : at + order]:
                    value = (value * 0x01000193 + c) % 2**32
                own.add(((value ^ order) * 0x9E3779B1 % 2**32) >> (32 - toxicity.BITS))
        z = sum(weight.get(f, 0.0) for f in own) + model[2]
        assert got[doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-9)


@pytest.mark.parametrize("shift", [8 * 160, 8 * 160 + 80, 37, 5 * 160 + 53])
def test_media_search(spark, shift):
    """Recall of pairs within MOST_BITS at any offset, also where the shift isn't a number of whole hops."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    wavs = {r.vec_id: bytes(r.media) for r in media.tunes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    changed = []
    for k in range(0, 40):
        rate, x = media.decode(wavs[k])
        x = np.concatenate([x[shift:], x[:100]]) + rng.normal(scale=150, size=len(x) - shift + 100)
        changed.append((1000 + k, bytearray(media.encode(x, rate))))
    table = spark.createDataFrame([(k, bytearray(w)) for k, w in wavs.items()] + changed, "vec_id bigint, media binary")
    prints = media.fingerprints(table).select(F.col("id").alias("class"), "print")
    found = {(r["class"], r.match): r for r in media.search(prints, prints.where("class >= 1000").select("class")).collect()}
    own = {r["class"]: np.frombuffer(r["print"], "<u4") for r in prints.collect()}
    brute = set()
    for q in range(1000, 1040):
        for m in own:
            if m == q:
                continue
            for offset in range(-60, 61):
                x, y = own[q][max(0, -offset) :], own[m][max(0, offset) :]
                n = min(len(x), len(y))
                if n >= media.LEAST_OVERLAP and np.unpackbits((x[:n] ^ y[:n]).view(np.uint8)).mean() <= media.MOST_BITS:
                    brute.add((q, m))
                    break
    assert len(brute) >= 30 and len(brute & set(found)) >= 0.9 * len(brute)
    assert set(found) <= brute
    assert all(abs(found[q, q - 1000].offset - shift / media.HOP) <= 1 for q in range(1000, 1040) if (q, q - 1000) in found)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        new = stage(spark, kept, SMALL).cache()
        assert new.columns == docs.columns, name
        assert set(r[0] for r in new.select("doc_id").collect()) <= set(r[0] for r in kept.select("doc_id").collect())
        if name == "near duplicates":
            brute = groups_brute([(r.doc_id, r.text or "") for r in kept.select("doc_id", "text").collect()], 5, 8, 10)
            assert sorted(r[0] for r in new.select("doc_id").collect()) == sorted(set(brute.values()))
        kept = new
    last = corpus_pipeline.STAGES[4][1](spark, kept, SMALL)
    assert last.count() == kept.count()
