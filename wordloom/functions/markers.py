"""Words that end clauses in Burmese, by what they do."""

# Marker words by kind, tails of nominalized phrases, and the words of quotations.
STRONG = [
    "က", "ကျ", "ကျတော့", "ကျရင်", "လျှင်", "ရင်", "မူ", "ပါမူ", "မှ", "မှန်လျှင်", "မှန်ရင်", "သော်", "သော်လည်း", "သော်ငြားလည်း", "စေကာမူ", "ပေမဲ့", "ပေတဲ့", "လင့်ကစား", "ဆိုပေမယ့်", "ဆိုသော်လည်း",
    "မည်သို့ဆိုစေ", "တုန်းက", "တော့", "တော့ခါ", "တိုင်း", "ကတည်းက", "ဆိုကတည်းက", "ပြီးလျှင်", "ပြီးတော့", "ပြီးနောက်", "ပြီးမှ", "ပြီး", "ပြီးရင်", "ဆိုပြီး", "ဆိုပြီးတော့", "သဖြင့်", "ကြောင့်", "ကြောင့်မို့", "ကြောင့်မို့လို့", "မို့",
    "မို့လို့", "လို့", "ရကား", "ဆိုတော့", "ဆိုလို့", "ရန်", "ပါရန်", "ဖို့", "အောင်", "အောင်လို့", "သလို", "သကဲ့သို့", "ကဲ့သို့", "အတိုင်း", "သို့", "အလား", "နယ်", "လိုလို", "အထိ", "ထိ",
    "တိုင်", "တိုင်တိုင်", "တိုင်အောင်", "မချင်း", "အဆုံး", "ခင်", "မီ", "ချင်း", "ရော", "ဆိုရင်", "ဆိုသော်", "ဆိုရာတွင်", "ဆိုရာ၌", "ဆိုပါမူ", "အစား", "အရ", "အတွက်", "စဖူး", "ဖြစ်စေ", "ဖြစ်ဖြစ်", "မဆို",
]
MODERATE = [
    "၍", "ကာ", "လျက်", "ရက်", "ဟု", "ဟူ၍", "ရာ", "ရာတွင်", "ကာမျှ", "ကာမျှနှင့်", "ရင်း", "ယင်း", "တုန်း", "ကောင်းဆဲ", "ကောင်းတုန်း", "ယောင်", "ယောင်ယောင်", "အယောင်", "ဆိုကာ", "ချည်",
    "တုံ", "လိုက်", "ဟယ်", "လား", "စဖွယ်", "ဖြင့်", "အားဖြင့်", "နေနေသာသာ", "ပဲ", "ဘဲ",
]
FINAL = [
    "သည်", "၏", "တယ်", "ပါတယ်", "တာ", "သ", "ပြီ", "မည်", "မယ်", "မှာ", "လိမ့်မယ်", "လတ္တံ့", "အံ့", "ပိမ့်", "လား", "သလား", "လဲ", "လော", "စ", "စုံ",
    "နည်း", "တုံး", "ပေ", "ပဲ", "ပင်", "ပါ့", "ရဲ့", "ကဲ့", "တကား", "တမုံ့", "တည်း", "ချေ", "ဘူး", "ဖူး", "ပေါင်", "လော့", "လင့်", "ပါ", "ပေါ့", "နော်",
    "နော", "နှော", "ကိုး", "ဟာ", "ရယ်", "သကော", "ဥစ္စာ", "ချည်း", "ချည့်", "မြဲ", "စမြဲ", "ရိုး", "ရော", "ကရော", "နှင့်", "နဲ့",
]
NOMINALIZERS = [
    "မှု", "ချက်", "ခြင်း", "ရေး", "ပုံ", "နည်း", "သူ", "ဟာ", "တာ", "ရာ", "ကျိုး", "ခမန်း", "ခွင့်", "စ", "စရာ", "စိတ်", "တော်", "ဖော်", "ဖော်ရ", "ဖန်",
    "ဖွယ်", "ဖွယ်ရာ", "မည်", "မှာ", "ရိုး", "ရင်း", "ရုံ", "လေ့", "လုံး", "သံ", "ဟန်",
]
RELATIVIZERS = ["သော", "သည့်", "တဲ့", "မည့်", "မယ့်", "မဲ", "သား", "သ", "တယ်", "ပြီးသား", "နေကျ", "ရင်းစွဲ", "လက်စ"]
AUXILIARIES = [
    "ခဲ့", "နေ", "ပြီး", "လာ", "သွား", "ထား", "နိုင်", "ရ", "တတ်", "သင့်", "ထိုက်", "တန်", "တန်ရာ", "လွယ်", "ခဲ", "ဝံ့", "ရဲ", "စေ", "ခိုင်း", "ပေး",
    "ယူ", "ခံ", "မိ", "ကြ", "ပါ", "တော်", "မူ", "ဖူး", "ဖြစ်", "လိုက်", "ပစ်", "ကုန်", "လေ", "ပေ", "လတ်", "သေး", "ဦး", "အုံး", "ရစ်", "ချင်",
    "လို", "ကြည့်", "စမ်း", "စွာ", "ချ", "လှ", "လွန်း", "လွန်းအားကြီး", "အားကြီး", "လောက်", "ပျော်", "ပြ", "ပြန်", "ပြု", "ရက်", "ရှာ", "ယောင်", "နိုး", "နင့်", "ခင်",
    "လု", "လုနီး", "သာ", "အပ်", "အား", "ကောင်း", "စိန်", "လှည့်", "ပိုင်", "က်",
]
NOMINAL_TAIL = ["က", "မှ", "အရ", "အတွက်", "ကြောင့်", "ကြောင့်မို့", "ကြောင့်မို့လို့", "ကို", "တွင်", "မှာ", "သို့", "နှင့်", "နဲ့", "များ", "တို့"]
CASE_LIKE = ["မှာ", "သည်", "က", "မှ", "အရ", "အတွက်", "ကြောင့်"]
SAY, QUOTES, CONDITIONS, ADNOMINAL, TOPIC, PLURAL = "ဆို", ["ဟု", "ဟူ၍"], ["ရင်", "လျှင်", "မှ", "သော်"], ["မည်", "မှာ"], "သည်", "တို့"
