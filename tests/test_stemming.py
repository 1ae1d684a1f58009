import pytest

from cohortlens.functions.stemming import rouge_stem, stem
from cohortlens.operators.text_metrics import rouge_l_f

EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration
valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll is is""".split()


@pytest.mark.parametrize(("word", "wanted"), list(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True)))
def test_published_examples(word, wanted):
    assert stem(word) == wanted


def test_rouge_with_stems():
    assert rouge_stem("was") == "was"
    assert rouge_l_f("the lungs are cleared", "the lung are clearing", rouge_stem) == 1.0
    assert rouge_l_f("the lungs are cleared", "the lung are clearing") == 0.5
