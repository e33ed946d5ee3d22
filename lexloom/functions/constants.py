"""Fixed values of the text normaliser. They define the emotion label and must not be changed."""

# Emoticons that make a text happy or sad (substring match).
HAPPY = [":)", ":-)", ":D", ";)", ":]", ":P", ":3", ":o)", ":c)", ":>)", "=]", "8)", "=)", ":}", ":^)", "<3", "^_^", ";>", "(:", "(;"]
SAD = [":-(", ":(", ":-c", ":c", ":-<", ":<", ">:[", ":[", ":-[", ":{", ":'{", ":/"]

# The long lists, an alternative to the short ones above.
HAPPY_LONG = [":)", ":D", ";)", ":-)", ":P", "=)", "(:", ";-)", "XD", "=D", "=]", ";D", ":]", ":-D", "^_^", "8)", "(8", ":-P", "(;", ";P", ";]", "(=", "[:", "8D", ":'‑)", ":')", ":*", ":-*", ":^*", ">:P", "X‑P", "x‑p", ":‑p", ":p", "=p", ":‑Þ", ":‑b", ":b", "d:", "<3", "❤", "😸", "😼", "😻", "😺", "😹", "😲", "☺️", "😽", "😘", "😗", "😛", "😚", "😙", "😏", "😎", "😍", "😇", "😆", "😅", "😌", "😋", "😊", "😉", "😀", "😄", "😃", "😂", "😁", "😈"]
SAD_LONG = [">:]", ":-(", ":(", ":-c", ":c", ":-<", ":<", ":-[", ":[", ":{", ";(", ":-||", ":@", ">:(", ":'-(", ":'(", "D:<", "D8", "D;", "D=", "DX", "v.v", "D‑':", ">:O", ":-O", ":O", ":-o", ":o", "8‑0", "O_O", "o‑o", "O_o", "o_O", "o_o", "O-O", ">:/", "=/", "T_T", "=(", "=[", "😷", "😵", "😰", "😯", "😮", "😳", "😱", "😤", "😨", "😧", "😦", "😥", "😬", "😫", "😩", "😠", "😟", "😞", "😣", "😢", "😡", "🙀", "😿", "😾", "😖", "😕", "😔", "😓", "😒", "👿"]

# Words between a negator and an adjective that are skipped.
INTENSIFIERS = ["so", "very", "as", "such", "that", "much", "the", "a", "an"]

# Penn Treebank tags by lexicon class.
POS_CLASSES = {"a": ["JJ", "JJR", "JJS"], "n": ["NN", "NNS", "NNP", "NNPS"], "r": ["RB", "RBR", "RBS"], "v": ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"]}

# Defaults of this library for dictionaries that users normally supply as tables.
STOPWORDS = ["the", "and", "for", "with", "that", "this", "was", "our", "you", "from", "are", "has", "have", "like"]
VERBS = ["like", "go", "see", "trust", "stop", "talk", "survive", "expect", "sleep", "believe", "want", "need", "know", "get", "make", "fix"]
ANTONYMS = [("good", "bad"), ("happy", "sad"), ("quiet", "noisy"), ("cheap", "expensive"), ("bright", "gloomy"), ("warm", "chilly")]
SYNONYMS = {"kettle": ["teapot", "urn"], "coffee": ["espresso", "tea", "brew"], "morning": ["dawn"], "story": ["tale", "saga"], "stranger": ["outsider", "newcomer"], "nobody": ["no-one"], "people": ["folk", "persons"]}
ENTITIES = ["kettle", "coffee", "referee", "telescope", "jury", "nurse", "dividend", "choir", "suitcase", "compiler"]
