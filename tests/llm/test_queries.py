"""The registered queries themselves, over whole tables, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from keelson.llm import queries as Q
from test_operators import license_brute, pii_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return {r.doc_id: r for r in Q.QUERIES[name](spark, SF).collect()}


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    got = rows(spark, "op1_bpe")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        ids = t.encode(docs[i].text or "", add_special_tokens=False).ids
        want = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *want)


def test_op2(spark, docs):
    got = rows(spark, "op2_licenses")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_brute(docs[i].text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op3(spark, docs):
    got = rows(spark, "op3_mixing")
    assert got.keys() == docs.keys()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    by = defaultdict(list)
    for i, r in got.items():
        assert r.size == sizes[i] and r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by[docs[i].source].append(r)
    for source, some in by.items():
        whole = sum(r.size for r in some)
        assert {r.source_size for r in some} == {whole} and all(r.target <= 2 * whole + 1e-6 for r in some)
        assert abs(sum(r.taken for r in some) - some[0].target) <= max(r.size for r in some)
    assert sum({s: x[0].target for s, x in by.items()}.values()) <= 1.5 * sum(sizes.values()) + 1e-6


def test_op4(spark, docs):
    for i, r in rows(spark, "op4_media").items():
        raw = (docs[i].text or "").encode()
        padded = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes > len(padded) / 192 and r.feature.startswith(f"frames={len(padded) // 192};")


def test_op5(spark, docs):
    got = rows(spark, "op5_sharding")
    assert got.keys() == docs.keys()
    slots = defaultdict(list)
    for i, r in got.items():
        raw = (docs[i].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op6(spark, docs):
    for i, r in rows(spark, "op6_pii").items():
        base = pii_brute(docs[i].text)
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= {*r.spans.split(","), ""}


def fingerprint_brute(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op7(spark, docs):
    got = rows(spark, "op7_simhash")
    fps = {i: fingerprint_brute(r.text) for i, r in docs.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps and all(len(r.fingerprint) == 16 for r in got.values())
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in ids}


def test_op9_is_calibrated_at_few_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.QUERIES["op9_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    for held in (True, False):
        toxic = [r.predicted for r in got if labels.get(r.doc_id) == 1 and r.held_out == held]
        assert sum(toxic) >= 0.75 * len(toxic) > 0
    assert not any(r.predicted for r in got if labels.get(r.doc_id) == 0)


def test_op10_held_out(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = Q.QUERIES["op10_langid"](spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held) > 0
