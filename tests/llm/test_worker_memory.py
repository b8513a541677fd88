import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="memory is read from /proc")
def test_character_classes_are_made_in_little_memory():
    code = "\n".join([
        "import numpy, pyarrow, tokenizers",
        "from nightqueue.llm import words",
        "peak = lambda: int(next(x for x in open('/proc/self/status') if x.startswith('VmHWM')).split()[1])",
        "before = peak(); words.classes(); print(peak() - before)",
    ])
    grown = int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout)
    assert grown < 40_000  # kB; 130,000 when all code points were asked for at once


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read from /proc")
def test_encoder_remembers_many_words_in_little_memory():
    code = "\n".join([
        "import random, re, public_tokenizers",
        "from nightqueue.llm import bpe_prefix",
        "held = lambda: int(re.search(r'\\nPss_Anon:\\s+(\\d+)', open('/proc/self/smaps_rollup').read())[1])",
        "own = bpe_prefix.coder(open(public_tokenizers.path('word_bpe_49k.json'), 'rb').read())",
        "own.packed(['one word']); before = most = held(); r = random.Random(1)",
        "for _ in range(12):",
        "    own.packed([''.join(r.choices('etaoinshrdlu    ', k=5000)) for _ in range(200)]); most = max(most, held())",
        "print(most - before)",
    ])
    grown = int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout)
    assert grown < 80_000  # kB, 195,487 words; 103,548 when pairs were a dictionary and freed arrays stayed, 59,948 now
