"""Exception phrases are swept once, however many a text has."""

import random
import time

from weftline.llm import toxicity


def test_a_hundred_thousand_phrases_take_seconds():
    lexicon = toxicity.Lexicon({" trash ": 4.0, " clown ": 2.0})
    automaton = lexicon.automaton()
    began = time.perf_counter()
    assert lexicon.measure(toxicity.fold("trash can " * 100_000), automaton) == 0
    assert lexicon.measure(toxicity.fold("trash can trash " * 100_000), automaton) > 0
    assert time.perf_counter() - began < 20


def test_sweep_equals_the_definition():
    rnd = random.Random(2)
    lexicon = toxicity.Lexicon({" trash ": 4.0, " tra": 1.0, " clown ": 2.0, " can ": 0.5, " lose": 8.0}, exceptions=("trash can", "can clown", "sore loser can trash", "clown"))
    automaton = lexicon.automaton()
    for _ in range(300):
        folded = toxicity.fold(" ".join(rnd.choice(["trash", "can", "clown", "sore", "loser", "trap", "x"]) for _ in range(rnd.randint(0, 12))))
        covered = [(i, i + len(p) + 1) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
        best = {}
        for term, weight in lexicon.weights.items():
            for i in range(len(folded)):
                if folded.startswith(term, i) and len(term) > best.get(i, (0, 0))[0]:
                    best[i] = (len(term), weight)
        total = sum(w for i, (_, w) in best.items() if not any(a <= i < b for a, b in covered))
        assert abs(lexicon.measure(folded, automaton) - total / (1 + lexicon.share * folded.count(" ") ** 0.5)) < 1e-9
