import re
from collections import Counter

import pytest
from quillspace.llm import quality as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = list(zip(words, words[1:], words[2:], strict=False))
    n = Counter(three)
    covered = {i + k for i, w in enumerate(three) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(odd, make):
    rows = [(20, "a b c a b c"), (21, "a a a a"), (22, "x\n\nx\ny # $\n"), (23, "\x0b\x0ca\rb")]
    for docs in (odd, make(rows)):
        got = q.measured(docs).collect()
        texts = docs.select("doc_id", "text").collect()
        want = sorted((str(r["doc_id"]), *brute(r["text"])) for r in texts)
        assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_empty_table_and_policies(make):
    assert q.judged(q.ledger(make([]))).count() == 0
    assert q.ablations(q.ledger(make([]))).count() == 0
    entries = q.ledger(make([(1, "a b"), (2, "### " * 60), (3, " ".join(f"word{i}" for i in range(60)))]))
    kept = {r["doc_id"]: r["kept"] for r in q.judged(entries).collect()}
    assert kept == {1: False, 2: False, 3: True}
    rows = {(r["policy"], r["rule"]): r for r in q.ablations(entries).collect()}
    few = rows["base-1", "few_words"]
    assert (few["failed"], few["only_this"], few["kept_without"], few["rows"]) == (1, 1, 2, 3)
    assert rows["web-1", "symbols"]["only_this"] == 0


def test_no_python_in_the_plan(odd):
    plan = q.judged(q.ledger(odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


@pytest.mark.parametrize("policy", q.POLICIES)
def test_masks_are_distinct_bits(policy):
    assert bin(q.policy_mask(policy)).count("1") == len(q.POLICIES[policy])
