"""Word classes and punctuation that layout, packing and quality rules refer to."""

from __future__ import annotations

# ---- fixed values
LEADING = (
    "a an the and but or nor for so yet because although though while whereas since unless until if when whenever where wherever after before as that than whether "
    "of to in on at by with from into onto upon about over under through between among during without within toward towards against "
    "around across along behind beside besides beyond near past despite except inside outside underneath via amid atop which who whom whose"
)
DETERMINERS = "my your his her its our their this that these those some any no every each"
FORWARD = (
    "i we you he she they it am is are was were be been being do does did have has had will would shall should can could may might must ought "
    "let's lets i'm i've i'll i'd we're we've we'll we'd you're you've you'll you'd he's he'll he'd she's she'll she'd they're they've they'll they'd it's it'll that's there's here's"
)
PARTICLES = "up down out off in on over back away around through along apart"
QC_FUNCTION_WORDS = "a an the of to and or but with from in on at for that this these those"
QC_STOPWORDS = "a an the of to and or but with from in on at for that this these those is are was were"
BRIEF_RESPONSES = "yes no ok okay yeah right sure nope yep what why how stop wait hi hey hello thanks"
FILLERS = "um uh erm er ah eh hmm mm mhm uh-huh huh y'know like este pues bueno euh ben bah äh ähm"
FILLER_PHRASES = ("you know", "i mean", "sort of", "kind of", "or something", "or whatever", "i guess", "you see")
ALWAYS_CAPITAL = "i i'm i've i'll i'd"
COMMON_WORDS = (
    "a an the this that these those some any each every no all both either neither such another "
    "he she it we they you me him her us them my your his its our their mine yours hers ours theirs who whom whose which what there here "
    "it's he's she's we're they're you're we've they've you've we'll they'll you'll he'll she'll he'd she'd we'd they'd you'd that's there's here's what's who's "
    "and but or nor so yet for of in on at to by with from into onto over under about after before between through during against without within "
    "because although though while when where if unless until since as than like unlike toward towards "
    "is are was were be been being am do does did have has had will would can could shall should may might must "
    "won't don't doesn't didn't can't couldn't wouldn't shouldn't isn't aren't wasn't weren't haven't hasn't hadn't "
    "then now just not never always still even only also too very really again back away out up down off how why maybe perhaps please well okay"
)
SENTENCE_SIGNS = (".", "!", "?")
CLAUSE_SIGNS = (",", ";", ":", "—", "–")
CJK_SENTENCE_SIGNS = ("。", "！", "？", "．", "!", "?", ".")
CJK_CLAUSE_SIGNS = ("、", "，", "；", "：", "・", ",", ";", ":")
CJK_RANGES = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF), (0x3000, 0x303F), (0xFF00, 0xFFEF))
NO_LINE_START = "。、！？．，；：・）｝］」』〕〉》】〙〗｠ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮー!?,.:;)]}"
NO_LINE_END = "（｛［「『〔〈《【〘〖｟([{"
PAIRS = {"“": "”", "(": ")", "[": "]", "‘": "’", "«": "»"}
# ----
