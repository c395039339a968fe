"""Cases of the form (options, lexicon, input, output), a rule or two each."""

from versalia.options import CaseMode, CaseOptions, GermanMode, SeparatorStyle

T, S = CaseMode.TITLE, CaseMode.SENTENCE_TITLE
COLON = SeparatorStyle.COLON_SPACE
AGGRESSIVE, BALANCED = GermanMode.AGGRESSIVE, GermanMode.BALANCED
USER = [("canonical-map", "en", "iphone", "IPHONE", None, 0), ("protected-forms", "en", "tarn", "TARN", None, 0), ("canonical-map", "en", "tarn", "Tarn", None, 0), ("canonical-map", "en", "old mill", "Dead Key", None, 0)]
PHRASES = [("multiword-map", "en", "old mill road", "Old Mill Road", None, 0), ("multiword-map", "en", "old mill", "OLD Mill", None, 0), ("multiword-map", "en", "mill road east", "never", None, 0)]
RANKED = [("ranked-candidates", "de", "quelle", "Quelle", 4.0, 0), ("ranked-candidates", "de", "laut", "LAUT", 0.9, 0), ("ranked-candidates", "de", "regen", "Regen", 2.0, 0), ("ranked-candidates", "de", "regen", "REgen", 2.0, 1)]

CASES = [
    # marks of other scripts end sentences without a space
    (CaseOptions(locale="ja"), None, "早い。then it rained", "早い。Then it rained"),
    (CaseOptions(locale="en"), None, "ready？set", "Ready？Set"),
    (CaseOptions(locale="hi"), None, "pani aaya। it poured", "Pani aaya। It poured"),
    # case functions of languages
    (CaseOptions(locale="nl"), None, "ijs smelt snel", "IJs smelt snel"),
    (CaseOptions(locale="en"), None, "ijs melts fast", "Ijs melts fast"),
    (CaseOptions(locale="tr"), None, "izmir güzel", "İzmir güzel"),
    (CaseOptions(locale="tr"), None, "IRMAK aktı", "IRMAK aktı"),
    (CaseOptions(locale="tr", preserve_acronyms=False), None, "bir IRMAK aktı ve IŞIK", "Bir ırmak aktı ve ışık"),
    (CaseOptions(locale="el"), None, "Ο ΛΟΓΟΣ", "Ο λογος"),
    (CaseOptions(locale="lt", preserve_acronyms=False), None, "Jis JÌ rado", "Jis ji̇̀ rado"),
    (CaseOptions(locale="pl", mode=T), None, "end of the line", "End Of The Line"),
    (CaseOptions(locale="en", mode=T), None, "end of the line", "End of the Line"),
    # known forms; capitals that are kept or not
    (CaseOptions(), None, "she opened github on an ipad", "She opened GitHub on an iPad"),
    (CaseOptions(), None, "Every Single Word Shouts Here", "Every single word shouts here"),
    (CaseOptions(), None, "today Odo saw Vesna near Tarn", "Today Odo saw Vesna near Tarn"),
    (CaseOptions(locale="de"), None, "heute sahen wir die Neue Mühle", "Heute sahen wir die Neue Mühle"),
    (CaseOptions(preserve_existing_capitals=False), None, "today Odo saw Vesna", "Today odo saw vesna"),
    (CaseOptions(), None, "if i go, so do i", "If I go, so do I"),
    (CaseOptions(), None, "well i'd say i’ll wait", "Well I'd say I’ll wait"),
    (CaseOptions(), None, "IF I GO HOME", "If I go home"),
    (CaseOptions(), None, "their MacBride and eBook stay", "Their MacBride and eBook stay"),
    # apostrophes, hyphens and quotes
    (CaseOptions(), None, "won't they know", "Won't they know"),
    (CaseOptions(), None, "he typed 'icu4x' twice", "He typed 'ICU4X' twice"),
    (CaseOptions(mode=T), None, "a day at o'malley mill", "A Day at O'Malley Mill"),
    (CaseOptions(locale="fr", mode=T), None, "l'arbre d'orient et le vent", "L'Arbre d'Orient et le Vent"),
    (CaseOptions(locale="fr"), None, "l'arbre est tombé", "L'arbre est tombé"),
    (CaseOptions(), None, "co-owners met", "Co-owners met"),
    (CaseOptions(mode=T), None, "ruth-anne kvarn", "Ruth-Anne Kvarn"),
    (CaseOptions(mode=T), None, "i'm sure y'all heard i've left", "I'm Sure Y'all Heard I've Left"),
    # abbreviations and dots
    (CaseOptions(), None, "ask prof. krill p.m. or later", "Ask prof. krill p.m. or later"),
    (CaseOptions(), None, "see vol. 12 of it", "See vol. 12 of it"),
    (CaseOptions(), None, "he said no. they went", "He said no. They went"),
    (CaseOptions(), None, "tarn ltd. paid in full", "Tarn ltd. paid in full"),
    (CaseOptions(), None, "nails, screws, etc. Nobody came", "Nails, screws, etc. Nobody came"),
    (CaseOptions(locale="de"), None, "haus nr. 9 brennt", "Haus nr. 9 brennt"),
    (CaseOptions(locale="de"), None, "öl, salz usw. kam an", "Öl, salz usw. kam an"),
    (CaseOptions(), None, "öl, salz usw. came in", "Öl, salz usw. Came in"),
    (CaseOptions(), None, "it stopped. nobody spoke", "It stopped. Nobody spoke"),
    (CaseOptions(), None, "stop!no more", "Stop!No more"),
    (CaseOptions(), None, "well… maybe later", "Well… maybe later"),
    (CaseOptions(), None, "so... maybe later", "So... maybe later"),
    (CaseOptions(), None, "well… Maybe later", "Well… Maybe later"),
    (CaseOptions(), None, "so... Maybe later", "So... Maybe later"),
    (CaseOptions(), None, "about 7.25 litres", "About 7.25 litres"),
    # shouting and acronyms
    (CaseOptions(), None, "OLD RIVER SONGS", "Old river songs"),
    (CaseOptions(), None, "NEW YORK at THE RIVER", "New York at the river"),
    (CaseOptions(), None, "BBC vs NBC", "BBC vs NBC"),
    (CaseOptions(), None, "RIVERS ROSE TODAY. the BBC came", "Rivers rose today. The BBC came"),
    (CaseOptions(), None, "the GITHUB page", "The GitHub page"),
    (CaseOptions(), None, "buy A boat", "Buy a boat"),
    # words that are names or not
    (CaseOptions(), None, "old rust on iron", "Old rust on iron"),
    (CaseOptions(), None, "they write Rust daily", "They write Rust daily"),
    (CaseOptions(mode=T), None, "gloves of latex", "Gloves of LaTeX"),
    (CaseOptions(), USER, "an iphone near tarn and the old mill", "An IPHONE near TARN and the old mill"),
    # phrases, longest first
    (CaseOptions(), None, "NEW YORK was cold", "New York was cold"),
    (CaseOptions(), None, "van der waals wrote it", "Van der Waals wrote it"),
    (CaseOptions(), None, "what van der waals wrote", "What van der Waals wrote"),
    (CaseOptions(), PHRASES, "the old mill road east of the old  mill, old; mill", "The Old Mill Road east of the OLD Mill, old; mill"),
    # white space and separators
    (CaseOptions(), None, "first\nsecond", "First\nsecond"),
    (CaseOptions(), None, "  wide \t gap ", "Wide gap"),
    (CaseOptions(mode=S), None, "first\nsecond", "First second"),
    (CaseOptions(), None, "rule: no boats", "Rule: no boats"),
    (CaseOptions(mode=S, separators=COLON), None, "rule: no boats", "Rule: No boats"),
    (CaseOptions(mode=T, separators=COLON), None, "rivers: the end", "Rivers: The End"),
    (CaseOptions(separators=COLON), None, "pages 8 - 9 only", "Pages 8 - 9 only"),
    (CaseOptions(separators=COLON), None, "x <part> y", "X <part> y"),
    (CaseOptions(mode=S, separators=COLON), None, "river songs - live", "River songs: Live"),
    (CaseOptions(mode=S), None, "rows b - d moved", "Rows b - d moved"),
    (CaseOptions(mode=S), None, "as:is copy", "As:is copy"),
    (CaseOptions(mode=S), None, "river songs—second print", "River songs—Second print"),
    (CaseOptions(mode=S, separators=COLON), None, "notes on github - old rust parts", "Notes on GitHub: Old rust parts"),
    (CaseOptions(mode=S, capitalize_after_subtitle=False), None, "river songs: live", "River songs: live"),
    # German nouns
    (CaseOptions(locale="de", german_mode=AGGRESSIVE), RANKED, "wir hörten laut der quelle den regen", "Wir hörten laut der Quelle den REgen"),
    (CaseOptions(locale="de", german_mode=AGGRESSIVE), RANKED, "quelle und regen", "Quelle und REgen"),
    (CaseOptions(locale="de"), None, "wir sahen die leitung", "Wir sahen die leitung"),
    (CaseOptions(locale="de", german_mode=BALANCED), None, "wir sahen die leitung", "Wir sahen die Leitung"),
    (CaseOptions(locale="de", german_mode=BALANCED), None, "das, morgen sahen wir", "Das, morgen sahen wir"),
]
