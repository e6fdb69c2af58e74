"""Word lists of the comment features. Every function that uses one takes another list as a parameter."""

from __future__ import annotations

# What comments say beside the code, by category; those of EXPLANATORY tell why.
MARKERS = {
    "cause": "because|since|due to|owing to|as a result|that's why|which is why|hence|therefore|thus|so that|the reason",
    "purpose": "in order to|to avoid|to prevent|to make sure|to keep|so we don't|so it doesn't|so that|for the sake of|to allow|to support",
    "contrast": "but|however|although|though|even though|whereas|despite|instead of|rather than|unlike|unfortunately|actually|in fact",
    "warning": "careful|beware|warning|caution|danger|unsafe|must not|do not|don't|never|watch out|be careful|note that|note:|important|gotcha|caveat|careful with|keep in mind",
    "condition": "unless|otherwise|only if|in case|assuming|assume|assumes|provided that|as long as|whenever",
    "history": "for now|temporary|temporarily|workaround|work around|hack|kludge|legacy|deprecated|until|later|eventually|at the moment|currently|no longer|used to|previously|historically|backward compatibility|backwards compatibility|back compat",
    "reference": "see|refer to|according to|as per|per the|spec|rfc|cf.|issue|ticket|pull request|upstream|bug in",
    "tag": "todo|fixme|xxx|todo:|fixme:|xxx:",
    "hedge": "probably|maybe|perhaps|might|seems|appears|likely|not sure|i think|i guess|apparently|supposedly|somehow|presumably|hopefully|unclear|no idea|not certain",
    "modal": "should|must|need to|needs to|have to|has to|shall|ought to|cannot|can't|required|mandatory",
    "first_person": "i|i'm|i've|i'll|i'd|we|we're|we've|we'll|our|my|let's",
    "negation": "not|no|never|don't|doesn't|didn't|won't|can't|cannot|isn't|aren't|without|nothing|neither|nor",
}
EXPLANATORY = ("cause", "purpose", "contrast", "warning", "condition", "history", "reference", "tag")
GROUPS = {
    "reasons": "cause purpose contrast condition", "warnings": "warning", "debts": "history tag", "references": "reference", "stance": "hedge modal first_person negation",
}

# Idioms of programmers: name, category, connotation, forms. A form that two idioms have belongs to the first.
IDIOMS = [
    ("hack", "debt", "negative", "hack|hacks|hacky"), ("quick and dirty", "debt", "negative", "quick and dirty|quick & dirty"), ("workaround", "debt", "negative", "workaround|workarounds|work around"),
    ("tech debt", "debt", "negative", "tech debt|technical debt"), ("dead code", "debt", "negative", "dead code"), ("boilerplate", "debt", "neutral", "boilerplate"), ("magic number", "debt", "negative", "magic number|magic numbers"),
    ("off by one", "tech_idiom", "neutral", "off by one"), ("race condition", "tech_idiom", "neutral", "race condition|race conditions"), ("happy path", "tech_idiom", "neutral", "happy path"),
    ("edge case", "tech_idiom", "neutral", "edge case|edge cases|corner case|corner cases"), ("fast path", "tech_idiom", "neutral", "fast path|slow path"), ("no op", "tech_idiom", "neutral", "no op|noop"),
    ("sanity check", "tech_idiom", "neutral", "sanity check|sanity checks"), ("for now", "provisional", "negative", "for now|for the time being"), ("in sync", "tech_idiom", "neutral", "in sync|out of sync"),
    ("clean", "evaluative_pos", "positive", "clean|cleaner|elegant"), ("robust", "llm_register", "positive", "robust|robustly"), ("seamless", "llm_register", "positive", "seamless|seamlessly"), ("known hack", "debt", "negative", "known hack"),
]

# Verbs with which comments on code begin.
CODE_VERBS = """
add allocate allow append apply assert assign attach avoid begin bind build cache calculate call cancel change check clean clear clone close collect compare compute configure connect
construct convert copy count create decode decrement define delete detect disable drop emit enable encode ensure escape execute expand extract fetch fill filter find flush format
generate get handle hide ignore implement import increment initialize insert iterate join keep load lock log loop make map mark match merge modify move notify open order parse pass
perform print process push raise read register remove rename render replace reset resolve return run save scan send serialize set show skip sort split start stop store strip
switch test throw transform trigger trim truncate update use validate verify wait wrap write
""".split()

# Words of comments that say what a token of code says.
PARAPHRASES = {
    "for": "loop iterate each every", "while": "loop until repeat", "if": "check whether condition when", "else": "otherwise fallback default", "return": "give yield result output",
    "def": "function method define", "func": "function method define", "class": "type object define", "import": "load include use", "raise": "error throw fail", "throw": "error raise fail",
    "try": "attempt catch handle", "except": "catch handle error", "catch": "handle error", "len": "length size count", "size": "length count", "append": "add push", "push": "add append",
    "del": "remove delete drop", "null": "empty missing none", "none": "empty missing null", "print": "output log show", "log": "print record report", "range": "loop count", "new": "create make",
}
