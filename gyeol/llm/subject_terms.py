"""Curated subject terms: words of each trade by general knowledge, whether or not a corpus at hand has them.

For each subject the terms that nearly always mean it ("core") and those that it shares with others or with everyday
language ("side"). A term may stand under several subjects. Matching is by the start of a word, so a stem covers its
compounds and endings. These are priors only: ``gyeol.llm.subjects`` sets the weights from labelled documents and from
how many documents of the corpus a term is in.
"""

#: Prior weight of the two kinds of terms.
PRIOR = {"core": 1.0, "side": 0.5}

SUBJECT_TERMS = {
    "semiconductor": {
        "core": ["반도체", "웨이퍼", "메모리", "파운드리", "팹리스", "노광", "식각", "증착", "감광액", "클린룸", "집적회로", "디램", "낸드", "칩셋", "패키징", "미세 공정", "이미지 센서", "전력 반도체", "실리콘 카바이드",
                 "semiconductor", "wafer", "foundry", "fabless", "lithography", "etch", "cleanroom", "dram", "nand", "chiplet", "photoresist", "transistor", "integrated circuit", "image sensor", "chipmaker",
                 "마이크로프로세서", "그래픽 처리 장치", "포토마스크", "극자외선", "트랜지스터", "아날로그 칩", "시스템온칩", "microprocessor", "photomask", "extreme ultraviolet", "silicon carbide", "logic chip", "memory chip"],
        "side": ["수율", "칩", "장비 반입", "세정", "die", "yield", "substrate"],
    },
    "battery": {
        "core": ["이차전지", "배터리", "양극재", "음극재", "전해액", "전해질", "분리막", "전고체", "전구체", "동박", "리튬", "니켈", "충방전", "열폭주", "활물질", "파우치", "각형", "원통형 전지", "에너지저장장치",
                 "battery", "cathode", "anode", "electrolyte", "lithium", "separator", "solid-state", "precursor", "pouch cell", "cell assembly", "charging station", "energy storage", "gigafactory",
                 "코발트", "망간", "흑연", "나트륨 전지", "납축전지", "충전소", "배터리 관리", "리튬인산철", "cobalt", "manganese", "graphite", "sodium-ion", "accumulator"],
        "side": ["충전", "셀", "전극", "슬러리", "음극", "양극", "cell", "charge"],
    },
    "shipbuilding": {
        "core": ["조선소", "선박", "도크", "선체", "선주", "선급", "진수", "용골", "컨테이너선", "유조선", "벌크선", "운반선", "화물창", "밸러스트", "시운전", "예인선", "해양 플랜트", "추진축", "건조 계약", "의장 공사",
                 "shipyard", "shipbuilding", "hull", "dry dock", "tanker", "keel", "ballast", "vessel", "bulk carrier", "gas carrier", "container ship", "sea trial", "offshore platform", "classification society",
                 "해운", "선원", "여객선", "쇄빙선", "준설선", "프로펠러", "갑판", "조타", "shipowner", "ferry", "cruise ship", "dredger", "icebreaker", "deck"],
        "side": ["후판", "인도 시점", "용접", "배", "건조", "crane", "berth"],
    },
    "construction": {
        "core": ["시공", "토목", "분양", "재건축", "재개발", "아파트", "공동주택", "골조", "터널", "교량", "철근", "콘크리트", "기성금", "착공", "준공", "공정률", "도급", "하도급", "미분양", "정비 사업", "입주",
                 "construction site", "contractor", "subcontract", "apartment", "redevelopment", "tunnel", "bridge", "concrete", "rebar", "groundbreaking", "ground breaking", "housing complex", "progress billing", "civil works",
                 "건설사", "시멘트", "굴착기", "측량", "설계 변경", "감리", "상가 분양", "고속도로", "cement", "excavator", "surveyor", "skyscraper", "housing estate", "highway"],
        "side": ["현장", "공사", "자재", "건축", "scaffold", "completion"],
    },
    "biopharma": {
        "core": ["의약품", "신약", "임상", "백신", "항암", "항체", "바이오시밀러", "치료제", "투약", "품목 허가", "약동학", "비임상", "위약", "유전자 치료", "세포 배양", "제약", "부작용", "후보 물질", "이상 반응", "환자",
                 "clinical trial", "vaccine", "antibody", "biosimilar", "placebo", "bioreactor", "oncology", "drug", "patient", "dosing", "pharmacokinetic", "adverse event", "marketing approval", "gene therapy",
                 "항생제", "인슐린", "면역", "병원", "세포 치료", "혈액 제제", "식약처", "진단 시약", "insulin", "antibiotic", "immunotherapy", "hospital", "vaccination", "diagnostics"],
        "side": ["위탁 생산", "배양", "제형", "허가", "therapy", "dose", "contract manufacturing"],
    },
    "banking": {
        "core": ["대출", "예금", "여신", "수신", "연체율", "충당금", "순이자", "예대", "자본 비율", "위험 가중", "유동성 커버리지", "부실 채권", "보험료", "지급 여력", "책임 준비금", "카드론", "신용 등급", "은행", "건전성",
                 "lending", "deposit", "loan", "delinquency", "net interest", "risk weighted", "insurance premium", "liquidity coverage", "capital ratio", "credit exposure", "bancassurance", "underwriting", "solvency",
                 "주택담보", "저축은행", "환매조건부", "채권 발행", "자산 운용", "손해보험", "생명보험", "외환", "mortgage", "savings bank", "bond yield", "insurer", "foreign exchange", "bank"],
        "side": ["금리", "부도", "담보", "지점", "상환", "credit", "interest rate"],
    },
    "content_software": {
        "core": ["게임", "소프트웨어", "플랫폼", "웹툰", "음원", "스트리밍", "클라우드", "데이터센터", "이용자", "구독", "앱", "오픈베타", "캐릭터", "콘텐츠", "채팅", "서버", "추천 모형", "검색 광고", "접속자",
                 "software", "app store", "streaming", "cloud", "mobile game", "open beta", "server", "subscription", "active users", "webtoon", "in-game", "data centre", "data center", "user retention", "gameplay",
                 "인공지능", "영화", "드라마", "애니메이션", "이모티콘", "해킹", "오픈소스", "운영체제", "artificial intelligence", "animation", "operating system", "open source", "web service", "video game"],
        "side": ["신작", "결제", "업데이트", "개발", "이용권", "studio", "platform"],
    },
    "energy": {
        "core": ["발전", "송전", "변전", "배전", "정유", "정제", "원유", "석유화학", "태양광", "풍력", "수소", "연료전지", "배출권", "가스", "열병합", "터빈", "변압기", "초고압", "전력 구매", "집단 에너지", "양수", "송유관",
                 "power plant", "grid", "refinery", "refining margin", "crude", "solar", "wind farm", "offshore wind", "hydrogen", "fuel cell", "turbine", "substation", "pipeline", "emission permit", "power purchase", "high voltage",
                 "원자력", "석탄", "천연가스", "유가", "주유소", "지열", "바이오매스", "전기 요금", "nuclear", "coal", "natural gas", "oil price", "geothermal", "biomass", "electricity"],
        "side": ["전력", "기름값", "계통", "보일러", "바람", "fuel", "cable"],
    },
    "defense": {
        "core": ["방위 산업", "방산", "국방", "군수", "미사일", "유도 무기", "탄약", "자주포", "장갑차", "전투기", "함정", "레이더", "무인기", "무인 정찰", "위성", "발사체", "사격 통제", "대공", "전력화", "절충 교역", "군 당국",
                 "defence", "defense", "missile", "howitzer", "armoured", "armored", "fighter", "radar", "satellite", "launch vehicle", "munition", "fire control", "export licence", "warship", "reconnaissance",
                 "잠수함", "육군", "해군", "공군", "병력", "드론", "장갑", "포탄", "submarine", "army", "navy", "air force", "drone", "artillery", "troops"],
        "side": ["양산", "정비", "엔진", "시제", "overhaul", "payload"],
    },
    "consumer": {
        "core": ["백화점", "편의점", "면세점", "마트", "화장품", "식품", "음료", "라면", "간편식", "의류", "매장", "점포", "가맹점", "새벽 배송", "온라인 주문", "할인 행사", "소비자", "물류 센터", "자체 상표", "원두",
                 "convenience store", "department store", "duty free", "cosmetics", "beverage", "ready meal", "apparel", "franchise", "online order", "store", "grocery", "retail", "private label", "shopper",
                 "슈퍼마켓", "가전제품", "패션", "신발", "제과", "주류", "커피", "홈쇼핑", "supermarket", "footwear", "fashion", "coffee", "snack", "household goods"],
        "side": ["포장재", "반품", "명절", "재구매", "시즌", "distribution centre", "brand"],
    },
    "litigation": {
        "core": ["소송", "원고", "피고", "판결", "항소", "상고", "법원", "중재", "가처분", "가압류", "손해배상", "과징금", "담합", "변론", "시정 명령", "특허 침해", "소멸 시효", "구상권", "행정 심판", "제재", "화해 권고",
                 "lawsuit", "plaintiff", "defendant", "court", "arbitration", "injunction", "damages", "class action", "settlement", "patent infringement", "hearing", "appeal", "tribunal",
                 "검찰", "기소", "변호사", "위자료", "조정 절차", "파기 환송", "공정거래위원회", "배상액", "prosecutor", "indictment", "attorney", "litigation", "legal dispute", "antitrust"],
        "side": ["청구", "소장", "증거", "진술", "claim", "verdict"],
    },
    "governance": {
        "core": ["이사회", "주주총회", "사외이사", "감사위원회", "정관", "의결권", "배당", "지분", "최대주주", "주주 제안", "집중 투표", "전자 투표", "내부회계", "내부통제", "자기주식", "보상위원회", "특별관계자", "경영권", "소수 주주", "우선주",
                 "board", "annual meeting", "shareholder", "audit committee", "outside director", "proxy", "dividend", "cumulative voting", "internal control", "treasury share", "bylaws", "governance",
                 "이사 선임", "준법", "윤리 경영", "주주 환원", "액면 분할", "공시 위반", "내부 고발", "지주회사", "compliance", "shareholding", "stock split", "chairperson", "stewardship", "holding company"],
        "side": ["의장", "임원", "보수 한도", "반대표", "stake", "voting"],
    },
}
