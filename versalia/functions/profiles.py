"""Word lists of the supported languages."""

from __future__ import annotations

from dataclasses import dataclass, field


def _w(text: str) -> tuple[str, ...]:
    return tuple(text.split())


@dataclass(frozen=True)
class Profile:
    stop: tuple[str, ...] = ()
    particles: tuple[str, ...] = ()
    title: tuple[str, ...] = field(default_factory=lambda: _w("dr prof st"))
    numeric: tuple[str, ...] = field(default_factory=lambda: _w("no vol fig"))
    trailing: tuple[str, ...] = ("etc",)
    contraction_tails: tuple[str, ...] = ()
    elisions: tuple[str, ...] = ()


# These lists decide results.
PROFILES = {
    "en": Profile(_w("a an and as at but by for in nor of on or per the to vs via"), _w("de du van von"), _w("mr mrs ms dr prof st sr jr vs feat ft capt sgt col gen gov"), _w("no vol fig approx"), _w("etc co inc ltd dept"), _w("m ll ve re d s t all clock em")),
    "de": Profile(_w("am an auf der die das ein eine für im in mit oder und von zu"), _w("am an auf der die das ein eine im in mit von zu"), _w("dr prof hr fr st"), _w("nr bd ca"), _w("usw bzw ggf evtl etc")),
    "fr": Profile(_w("à au aux de des du et la le les ou"), _w("de des du la le les d’ l’"), _w("dr prof st ste mme mlle"), elisions=_w("l d j n m t s c qu jusqu lorsqu puisqu quoiqu")),
    "es": Profile(_w("a al con de del el en la las los o por para y"), _w("de del la las los"), _w("sr sra srta dr dra prof st"), _w("no núm vol fig")),
    "pt": Profile(_w("a as da das de do dos e em na no para por"), _w("da das de do dos"), _w("sr sra dr dra prof st")),
    "it": Profile(_w("a da de del della di e il in la le lo"), _w("da de del della di"), _w("sig dott prof dr st"), trailing=_w("ecc etc"), elisions=_w("l d un all dell nell sull sant")),
    "nl": Profile(_w("aan de den der en het in of op te van"), _w("de den der het te van"), _w("dhr mevr dr prof st"), _w("nr vol fig"), _w("enz etc")),
    "sv": Profile(_w("av den det en i och på som till"), numeric=_w("nr vol fig"), trailing=_w("osv etc")),
    "da": Profile(_w("af den det en i og på til"), (), _w("dr prof hr fru st"), _w("nr vol fig"), _w("osv mv etc")),
    "no": Profile(_w("av de den det en i og på til"), (), _w("dr prof hr fru st"), _w("nr vol fig"), _w("osv mv etc")),
    "fi": Profile(_w("ja mutta sekä tai vaan"), (), _w("prof tri hra rva"), _w("nro vol"), _w("jne ym esim etc")),
    "tr": Profile(_w("ama da de ile ve veya"), (), _w("dr prof av doç"), _w("no vol fig"), _w("vb vs vd etc")),
    "az": Profile(_w("amma da də ilə və ya")),
    "lt": Profile(_w("ar bei bet ir į iš su"), (), _w("dr prof gerb"), _w("nr vol"), _w("pvz kt etc")),
}
PROFILES |= {"nb": PROFILES["no"], "nn": PROFILES["no"]}
GERMAN_AMBIGUOUS = _w("heute morgen gestern anders zusammen schnell langsam")
GERMAN_ARTICLES = _w("der die das dem den des ein eine einer einem einen kein keine keiner keinem keinen mein meine dein deine")
GERMAN_NOUN_ENDS = _w("ung heit keit schaft tion ismus ität ling tum nis")
BUILTIN_FORMS = {"github": "GitHub", "latex": "LaTeX", "icu4x": "ICU4X", "iphone": "iPhone", "ipad": "iPad", "rust": "Rust"}
BUILTIN_AMBIGUOUS = ("rust", "latex")
BUILTIN_PHRASES = {"new york": "New York", "san francisco": "San Francisco", "van der waals": "van der Waals"}


def profile(language: str) -> Profile:
    return PROFILES.get(language, Profile())
