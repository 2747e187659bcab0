"""Word lists and patterns as data. All of them are fixed values: results depend on them literally."""

# Fixed values.
FORBIDDEN_PHRASES = [
    "文中指出", "文中提到", "文中认为", "文中表明",
    "本文指出", "本文认为", "本文表明", "本文中", "文本中", "实验中", "试验中",
    "文章指出", "文章认为", "文章表明", "文章中",
    "本研究指出", "本研究认为", "本研究表明", "本研究", "研究中",
    "该研究指出", "该研究认为", "该研究表明", "该研究", "该章节",
    "在该实验中", "在本实验中", "在本研究中", "在这项研究中",
    "在这篇文章中", "在该文章中", "在该论文中", "在上述研究中",
    "根据给定内容", "根据上述内容", "根据文中内容", "根据本文内容", "根据文本内容",
    "作者认为", "作者指出", "作者提到",
    "根据给出的", "根据给出的文本", "根据给出的内容",
    "这段文字", "这段文本", "这段内容", "这段研究", "这段描述",
]
STUDY_BOOK = [
    "根据(本|该|这项)?研究", "在(本|该|这项)?研究中", "(本|该)研究表明", "(本文|该文)(中)?(认为|指出|表明|描述)",
    "(结果|摘要|讨论|方法)(部分)?指出", "在(本|该)?实验中", "(本|该)实验(中)?", "该论文(中|指出|认为|表明)",
]
STUDY_PAPER = [
    "根据(本|该|这项)?研究", "在(本|该|这项)?研究中", "(本|该)研究表明", "(本文|该文)(中)?(认为|指出|表明|描述)",
    "(结果|摘要|讨论|方法)(部分)?指出", "在(本|该)?实验中", "(本|该)实验(中)?", "(本|该)试验(中)?", "在(本|该)?体系中", "(本文|该文)描述的.*体系中",
    "这项研究(中|表明|发现)", "这篇文章(中|指出|认为|表明)", "该论文(中|指出|认为|表明)",
]
STUDY_THESIS = [
    "根据(本|该|这项)研究", "在(本|该|这项)研究中", "(本|该)研究表明", "(本文|该文|本论文|本学位论文)(中)?(认为|指出|表明|描述|提出)",
    "在(本|该)?实验中", "(本|该)实验(中)?", "该论文(中|指出|认为|表明)",
    r"\bwe (find|found|show|demonstrate|observe)\b", r"\bour (results|study|work)\b", r"\bin this (paper|thesis|study)\b",
]
AUTHOR_WORDS = [
    "作者", "通讯作者", "第一作者", "共同作者", "作者信息", "作者单位", "作者顺序", "作者排序", "作者贡献", "作者简介",
    "联系作者", "联系方式", "电子邮箱", "邮箱地址", "通讯方式", "通信地址", "单位信息",
    "affiliation", "corresponding author", "co-author", "coauthor", "author list", "author order", "author contribution", "contributing authors",
]
AUTHOR_PATTERNS = ["corresponding author", "first author", "co[- ]author", r"author\(s\)"]
CONDITION_PATTERNS = [
    "如果[^，。；：]{0,50}[，。；：]", "假设[^，。；：]{0,50}[，。；：]", "当[^，。；：]{0,50}时[，。；：]", "若[^，。；：]{0,50}[，。；：]",
    "倘若[^，。；：]{0,50}[，。；：]", "观测到[^，。；：]{0,50}[，。；：]", "发现[^，。；：]{0,50}[，。；：]",
]
GUIDE_PATTERNS = [
    "基于[^，。；：]{0,20}(信息|事实|条件|数据|结果|发现)", "根据[^，。；：]{0,20}(信息|事实|条件|数据|结果|发现)", "已知[：:]", "观测到[^，。；：]{0,20}[，。；：]",
]
SUMMARY_PHRASES = ["综合这些信息", "综合上述信息", "基于上述信息", "根据上述信息", "综合以上信息", "基于以上信息", "根据以上信息"]
REDUNDANT_GUIDES = [
    "已知：", "已知:", "基于以下信息：", "基于以下信息:", "根据以下事实：", "根据以下事实:", "如下信息：", "如下信息:", "信息如下：", "信息如下:", "前提条件：", "前提条件:",
    "基于这些信息：", "基于这些信息:", "根据这些信息：", "根据这些信息:", "基于以下事实：", "基于以下事实:", "根据以下条件：", "根据以下条件:",
]
REFERENCE_TEXT = "(文中|本文|文章中|根据文本|根据以上文本|根据上述文本|给定文本|这段文字|这段文本|这段内容|这段研究|这段描述)"
SKIP_SECTIONS = [
    "references", "bibliography", "acknowledg", "appendix", "supplementary", "author contribution", "competing interest",
    "conflict of interest", "funding", "abbreviations", "compliance with ethical standards",
]
REFERENCE_LINES = [r"\d+\.\s+[A-Z][^.]+\.[A-Z][^.]+\.[\s\d]", r"\[?\d+\]?\s+[A-Z]", r"et al\.\s*\d{4}"]
INJECTION = [
    r"forget\s+the\s+identity", r"ignore\s+previous\s+instructions", r"disregard\s+system", r"bypass\s+safety", r"developer\s+message",
    r"system\s+prompt", r"please\s+forget\s+", "请忽略.*指令", "忘记.*(开发者|系统|规则|指令)",
]
PATENT_MARKS = ["发明", "专利", "权利要求", "说明书", "摘要", "附图", "实用新型", "外观设计"]
FRENCH_LETTERS = "[éèêàùçïîôûÉÈÊÀÙÇÏÎÔÛ]"
FRENCH_WORDS = ["remerciements", "résumé", "resume", "jury d", "avant-propos", "préface"]
VAGUE = ["等等", "其他", "各种", "相关", "一定", "可能"]
CONNECTORS = ["因此", "所以", "从而", "进而", "导致", "由于", "因而", "首先", "其次", "最后"]
SUSPECT_MARKS = ["...", "？？", "。。", "??", "!!!"]
PENALTIES = {
    "vague_reference": (14, ["文中", "本文", "文章中", "该章节", "该部分", "本图书", "本书", "我们发现", "我们得出"]),
    "incomplete": (8, ["等等", "其他", "各种", "诸多", "若干", "相关", "有关", "一定", "某些", "部分"]),
    "redundant": (8, ["非常重要的", "至关重要的", "极其重要的", "非常关键的", "极其关键的"]),
    "academic_violation": (22, ["根据本实验", "通过本实验", "本研究表明", "如图所示", "见表", "见图"]),
}
ACADEMIC = ["机制", "原理", "方法", "理论", "规律", "特征", "因素", "假设", "模型", "推导", "约束"]
TECHNICAL = [
    "分子", "基因", "蛋白", "酶", "代谢", "通路", "调控", "表达", "基因组", "转录", "翻译", "突变", "育种", "遗传", "表型",
    "生理", "生态", "系统", "机制", "途径", "网络", "信号",
    "molecular", "gene", "protein", "enzyme", "metabolic", "pathway", "regulation", "expression", "genome", "transcription", "translation",
    "mutation", "breeding", "genetic", "phenotype", "physiological", "ecological", "system", "mechanism", "network", "signal",
]
METHOD_WORDS = ["method", "methods", "methodology", "approach", "procedure", "protocol", "实验方法", "研究方法", "技术路线", "实验设计", "材料与方法", "实验流程", "操作步骤"]
RESULT_WORDS = ["result", "results", "findings", "outcomes", "performance", "evaluation", "assessment", "实验结果", "研究结果", "数据分析", "结果分析", "测试结果", "对比结果", "对比分析", "消融"]
STARTERS = ["如何", "为什么", "什么", "怎样", "哪些", "哪个", "多少", "会不会", "能否", "如何进行", "如何实现", "为什么说", "什么是"]
QUESTION_TYPES = [("定义型", ["定义", "概念", "是什么"]), ("方法型", ["方法", "技术", "如何"]), ("原因型", ["原因", "为什么"]), ("对比型", ["比较", "对比", "区别"]), ("应用型", ["应用", "用途", "作用"])]
STOPWORDS = ["的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "那", "里", "后", "以", "所", "如果", "如何", "什么", "为什么", "怎么", "哪些", "怎样"]
