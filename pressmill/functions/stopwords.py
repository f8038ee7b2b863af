"""Stop words by language.

Languages with a list in Spark's StopWordsRemover have it (stopword_lists), and the most frequent
function words here besides; the rest have these alone.  All lists are small constants, fit for literals in expressions.
"""

from __future__ import annotations

from functools import lru_cache

from pressmill.functions.stopword_lists import SPARK

ENGLISH = frozenset("""
a able about above across after again against ago all almost alone along already also although always am among an and another any anybody anyone
anything anywhere are around as ask at away back be became because become been before began behind being below best better between both but by call
came can cannot come could did different do does doing done down during each early either else end enough even ever every everyone everything far
few find first five for former found four from full further gave get give given go goes going gone good got had has have having he help her here
hers herself high him himself his how however i if in indeed inside instead into is it its itself just keep kept knew know known large last late
later least left less let like likely little long look made mainly make many may maybe me mean might mine more most much must my myself near need
never new next no nobody none nor not nothing now nowhere of off often old on once one only onto or other others our ours out outside over own part
per perhaps please put quite rather really right said same saw say second see seem seen several shall she should show side since six small so some
somebody someone something sometimes somewhere soon still such take tell ten than that the their theirs them themselves then there these they thing
think third this those though thought three through thus to today together told too took toward towards tried try turn two under until up upon us
use used very via want was way we well went were what whatever when where whether which while who whole whom whose why will with within without
won would year yes yet you your yours yourself
""".split()) | frozenset(SPARK["en"].split())

#: What the news analysis leaves out besides: agencies, calendar, numbers.
NEWS = ENGLISH | frozenset("""
monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december
mon tue wed thu fri sat sun 0 1 2 3 4 5 6 7 8 9 10 am pm year years percent news home page section story stories photo video tweet says according
reuters press agency report reports reported time times -
""".split())

NAMES = {
    "ar": "Arabic", "be": "Belarusian", "bg": "Bulgarian", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "et": "Estonian", "fa": "Persian", "fi": "Finnish", "fr": "French", "he": "Hebrew",
    "hi": "Hindi", "hr": "Croatian", "hu": "Hungarian", "id": "Indonesian", "it": "Italian", "ja": "Japanese", "ko": "Korean", "lt": "Lithuanian", "mk": "Macedonian", "nb": "Norwegian (Bokmål)", "nl": "Dutch", "no": "Norwegian",
    "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sl": "Slovenian", "sr": "Serbian", "sv": "Swedish", "sw": "Swahili", "th": "Thai", "tr": "Turkish", "uk": "Ukrainian", "vi": "Vietnamese", "zh": "Chinese",
}

_FEW = {
    "ar": "في من على إلى عن أن إن كان كانت هذا هذه ذلك التي الذي ما لا لم لن قد كل بعد قبل بين مع هو هي و أو ثم حتى عند منذ كما غير",
    "be": "і ў на не што з да як але гэта за яго па ён яна мы вы яны ад пра для",
    "bg": "и в на не се да от за с по че е са като това при до но или към този те той тя ние",
    "da": "og i at det er en den til på de som med for der af ikke et han hun var vi jeg fra om",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei",
    "el": "και το να του η της με που την για από είναι στο τα των ο οι σε θα τον δεν ένα μια στη αυτό ως",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo",
    "et": "ja on ei et see ta kui oli ka mis nii aga või oma siis ning kes ma",
    "fa": "و در به از که این است را با برای آن یک خود تا کرد بر هم نیز گفت می شد ها",
    "fi": "ja on ei se että hän oli mutta ovat kun niin myös tai joka kuin sen mitä nyt jos",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son nous mais comme on cette aux ces ont été leur sa être tout elle fait deux même aussi je sans vous si entre peut après dont avait lui ses quand bien",
    "he": "של את על לא הוא כי זה גם היא עם אם אני יש היה הם אבל או כל מה",
    "hi": "के में की है से को का और पर यह ने कि एक भी हैं इस नहीं तो हो था कर गया वह लिए अपने",
    "hr": "i je u se na da su za od s što kao ne o iz koji to bi ili ali te do sam",
    "hu": "a az és hogy nem is egy ez meg volt de csak már el azt mint ha van",
    "id": "yang dan di ke dari ini itu dengan untuk pada tidak adalah dalam akan juga oleh saya ada kami",
    "it": "di che e la il un a è per in una mi sono ho non ma lo ha le si ti i con cosa se io come da ci no questo qui del al",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や など",
    "ko": "은 는 이 가 을 를 의 에 에서 와 과 도 로 으로 고 다",
    "lt": "ir kad į su iš bet yra tai kaip jo ar buvo už nuo dėl tik jau",
    "mk": "и на во да се не од за со е што тоа како но или ќе",
    "nb": "og i det som en på er til at av for å med de har ikke den et var om fra",
    "nl": "de en van het een in is dat op te zijn met voor niet die aan er om ook als dan maar bij",
    "no": "og i det som en på er til at av for å med de har ikke den et var om fra",
    "pl": "w i na z się nie do to że jest o a za od po jak co ale przez dla jego są tak czy był ma",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando",
    "ro": "și în de la cu pe nu a se că este din un o pentru mai ca care sunt sau dar fi",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой от так о для ты же все год вы",
    "sl": "in je v da se na za so ne pa z ki bi s kot od tudi ali po",
    "sr": "и је у да се на су за од са не што као који то или али из би",
    "sv": "och i att det som en på är av för med den till inte har de ett om var jag han från",
    "sw": "na ya wa kwa ni za katika la cha kama hii au lakini kuwa si yake",
    "th": "ที่ และ ใน ของ เป็น มี ได้ ให้ จะ ไม่ ว่า กับ การ นี้ แต่ จาก",
    "tr": "ve bir bu da de için ile çok ne o gibi daha ama en mi var olarak sonra kadar her",
    "uk": "і в не на що з до як але це за його по він вона ми ви вони від про для та",
    "vi": "và của là có trong không cho được một với các những này đã người để từ khi",
    "zh": "的 一 是 不 了 在 人 有 我 他 这 个 们 中 来 上 大 为 和 国 地 到 以 说 时",
}


@lru_cache(64)
def stopwords(language: str = "en") -> frozenset[str]:
    """A language's stop words; ValueError for a language that isn't in NAMES."""
    if language not in NAMES:
        raise ValueError(f"no stop words for {language!r}")
    code = "nb" if language == "no" else language
    return ENGLISH if code == "en" else frozenset(_FEW[code].split()) | frozenset(SPARK.get(code, "").split())
