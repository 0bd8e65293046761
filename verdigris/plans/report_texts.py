"""The wording of both Markdown reports, in order of appearance."""

UNIT_TABLE = [
    "| raw_aspect | aspect | raw_status | status | excerpt | opinion | sentiment |",
    "|---|---|---|---|---|---|---|",
]
NO_PRODUCT_ATTRIBUTE = "배송 상태와 같이 상품과 관련되지 않은 속성은 추출하지 않습니다."

STATIC_TITLE = "# {} 상품에 대한 정적 카탈로그 분석 보고서"
STATIC_INTRO = "{} 상품에 대한 정적 카탈로그 분석 보고서입니다."
STATIC_COUNTS = "{}개의 리뷰에서 {}개의 Opinion Units 속성을 추출하였습니다."
STATIC_REDUCTION = (
    "군집화를 통해 기존 {}개였던 aspect의 가짓 수를 {}개로 {} 감소시켰으며, aspect에 종속된 "
    "status의 가짓 수를 {}개에서 {}개로 {} 감소시켰습니다. 최종적으로 aspect-status 조합의 고유 "
    "가짓 수는 {} 감소했습니다."
)
LATEST_HEADING = "## 최근 추가된 리뷰와 속성"
NO_LATEST = "최근 추가된 리뷰가 없습니다."
ASPECT_SECTION = [
    "",
    "## 속성 감성 행렬 (상위 10개)",
    "",
    "리뷰를 aspect 단위로 분석한 표입니다.",
    "",
    "- `etc`는 차례대로 mixed/neutral/unknown의 개수입니다.",
    "- `mention rate`의 분모는 해당 상품의 전체 카탈로그 리뷰입니다.",
    "",
    "| rank | aspect | reviews(mention rate) | positive(rate) | negative(rate) | etc |",
    "|---:|---|---:|---:|---:|---:|",
]
TOP_ASPECT = "- 가장 넓게 언급된 aspect는 '{}'{} {}개의 리뷰에서 언급되었습니다."
NEGATIVE_ASPECT = "- 부정 리뷰가 가장 많은 aspect는 '{}'{} {}개의 리뷰에서 언급되었습니다."
NO_NEGATIVE_ASPECT = "- 상위 표시 aspect에는 부정 리뷰가 없습니다."
PAIR_SECTION = [
    "",
    "## 속성-상태 행렬 (상위 10개)",
    "",
    "리뷰를 aspect와 status 조합 단위로 분석한 표입니다.",
    "",
    "- `positive wilson lower`는 표본 수를 보수적으로 반영한 긍정 비율의 95% Wilson 하한입니다.",
    "- `etc`는 차례대로 mixed/neutral/unknown의 개수입니다.",
    "",
    "| rank | aspect > status | reviews(mention rate) | positive(rate) | negative(rate) | etc | "
    "positive wilson lower |",
    "|---:|---|---:|---:|---:|---:|---:|",
]
TOP_PAIRS = "- 가장 많이 언급된 제품 속성은 {}입니다."
NEGATIVE_PAIR = (
    "- 전체 aspect-status 조합에서 부정 리뷰가 가장 많은 항목은 '{}'{} {}개의 리뷰에서 "
    "언급되었습니다."
)
NO_NEGATIVE_PAIR = "- 전체 aspect-status 조합에 부정 리뷰가 없습니다."
DEBATED_HEADING = "## 가장 논쟁적인 속성"
DEBATED = (
    "{}{} 긍정 {}, 부정 {}로 상위 10개의 aspect 중 가장 작은 긍정/부정 비율 차이인 {}를 보이는 "
    "가장 논쟁적인 aspect입니다."
)
POSITIVE_SAMPLES = "### 긍정 리뷰 샘플"
NEGATIVE_SAMPLES = "### 부정 리뷰 샘플"
NO_SAMPLES = "- 근거 없음"
NOT_DEBATED = (
    "상위 10개의 aspect에 긍정 또는 부정 표본이 없어 논쟁적인 aspect를 계산하지 않았습니다."
)
RELATED_HEADING = ["", "## 관련 상품", "", "### 유사 상품", ""]
MOST_SIMILAR = (
    "본 상품과 리뷰 경험이 가장 유사한 제품은 리뷰 경험 유사도 값 {}을 가지는 {}입니다. 이는 "
    "experience similarity를 기반으로 evidence overlap과 support reliability를 고려하고 "
    "계산되었습니다."
)
NONE_SIMILAR = "본 상품과 비교 가능한 리뷰 경험 유사 상품이 없습니다."
SIMILAR_TABLE = [
    "",
    "- **experience similarity**: 각 상품 aspect들을 긍정/부정/혼합/중립 값을 벡터화하여 코사인 "
    "유사도 값을 계산합니다.",
    "- **evidence overlap**: 공통적으로 가지는 aspect 비율.",
    "- **support reliability**: 공통 aspect의 관측 리뷰 수가 충분한지를 반영한 신뢰도.",
    "  - 높을수록 소수 리뷰의 우연한 감성보다 반복 관측된 근거에 기반합니다.",
    "",
    "| rank | product | experience similarity | evidence overlap | support reliability |",
    "|---:|---|---:|---:|---:|",
]
REPAIR_HEADING = ["", "### 관찰된 약점을 보완하는 대안 상품", ""]
WEAKNESSES = "본 상품에는 {}과 같은 부정적인 aspect-status 속성이 존재합니다."
NO_WEAKNESSES = "본 상품에는 support 2 이상으로 확인된 부정적인 aspect-status 속성이 없습니다."
BEST_REPAIR = (
    "부정 속성을 기피 조건으로 두고 약점을 보완할 수 있는 상품은 '{}'입니다. 이는 weakness "
    "utility과 experience similarity를 3:1로 결합한 최종 점수인 weakness repair score를 기반으로 "
    "계산되었습니다."
)
NO_REPAIR = "근거가 확인된 약점 보완 후보가 없어 추천을 보류했습니다."
REPAIR_TABLE = [
    "",
    "- **weakness utility**: 원본의 부정 조건에 대해 후보가 얼마나 유리한지를 나타내는 근거 "
    "점수(-1~1로 정규화).",
    "- **experience similarity**: 상품의 유사성으로 약점 보완 순위가 어느 정도의 원본 경험 "
    "유사성을 유지하는지를 평가.",
    "- **weakness repair score**: weakness utility과 experience similarity를 3:1로 결합한 최종 "
    "점수로 비슷한 맥락에서 약점을 해결할 근거가 됩니다.",
    "",
    "| rank | product | weakness utility | experience similarity | weakness repair score |",
    "|---:|---|---:|---:|---:|",
]

DYNAMIC_TITLE = "# 동적 의사결정 제안서"
DYNAMIC_SUBMITTED = "{}에 제출된 {}에 대한 리뷰"
DYNAMIC_PURPOSE = "를 기반으로 의사결정을 보조하는 제안서입니다."
DYNAMIC_UNITS = "제출된 리뷰에서 추출 및 정규화된 속성은 다음과 같습니다."
FIELD_MEANINGS = [
    "",
    "- **raw_aspect**: 추출 시점에 정규화하지 않고 기록한, 리뷰어가 평가한 상품 속성·구성요소·사용 "
    "상황의 원본 명칭.",
    "- **aspect**: raw_aspect를 그대로 쓰거나 같은 product category 안의 군집 대표명으로 정규화한 "
    "최종 분석 속성.",
    "- **raw_status**: raw_aspect의 관찰된 상태·조건·값이며, 근거 있는 상태를 특정할 수 없을 때만 "
    "null을 가집니다.",
    "- **status**: raw_status를 그대로 쓰거나 해당 aspect 군집 안의 군집 대표명으로 정규화한 최종 "
    "분석 상태값.",
    "- **excerpt**: 해당 Opinion Unit을 뒷받침하도록 리뷰 원문에서 변경 없이 복사한 연속 구간.",
    "- **opinion**: 방향·정도·비교·사용 맥락을 보존해 리뷰어의 관찰 또는 평가를 간결하게 완결한 "
    "서술.",
    "- **sentiment**: 해당 aspect·status에 대한 리뷰어의 평가 방향으로 positive, negative, mixed, "
    "neutral, unknown 중 하나의 값을 가집니다.",
    "",
    "배송 상태와 같이 상품과 관련되지 않은 속성은 추출하지 않으며, 특별한 상품 속성 없는 긍정/부정 "
    "리뷰는 '전반적 상품 경험'이라는 속성값을 가집니다.",
    "",
    "## 다른 리뷰와의 관계",
]
NOTHING_COMPARED = (
    "제출된 Opinion Unit이 카탈로그의 정규화된 상품 속성과 연결되지 않아 비교할 수 없습니다."
)
ASPECT_MENTIONS = "전체 리뷰 {}개 중 {} 관련 언급은 {}개 리뷰에서 관찰됐습니다."
PAIR_MENTIONS = " 이 중 {} 상태는 {}개 리뷰에서 관찰됐습니다."
PAIR_COMPARED = (
    "제출된 리뷰를 제외하고 동일한 {} 조합을 언급한 리뷰 중 {}개는 부정, {}개는 긍정, {}개는 혼합 "
    "평가였습니다. 제출된 리뷰의 평가는 다수 리뷰의 평가 방향과 '{}'."
)
ASPECT_COMPARED = (
    "제출된 Opinion Unit에 상태가 없어 {} 단위로만 비교했습니다. 제출된 리뷰의 평가는 다수 리뷰의 "
    "평가 방향과 '{}'."
)
PAIR_UNMENTIONED = (
    "제출된 리뷰를 제외한 다른 리뷰에는 {} 조합과 완전히 일치하는 aspect-status가 없습니다."
)
NO_OTHER_STATUS = "제출된 리뷰를 제외한 다른 리뷰에는 {}의 status 관찰 자체가 없습니다."
OTHER_STATUSES = (
    "대신 제출된 리뷰를 제외한 {}의 가장 많이 언급된 status Top 3는 다음과 같습니다."
)
OTHER_STATUS_TABLE = [
    "",
    "| rank | status | reviews | positive | negative | etc |",
    "|---:|---|---:|---:|---:|---|",
]
DIRECTION_UNKNOWN = (
    "따라서 제출된 리뷰의 평가는 다른 리뷰 다수와의 방향 일치를 판단하기 어렵습니다."
)
UNRESOLVED_TABLE = [
    "",
    "| raw_aspect | raw_status | sentiment | mapping state | suggested aspect | suggested status | "
    "reason |",
    "|---|---|---|---|---|---|---|",
]
UNRESOLVED_COMPARISON = [
    "",
    "### 다른 리뷰와의 비교가 보류된 Opinion Unit",
    "",
    "아래 Unit은 mapping table exact match가 없어 canonical aspect-status로 확정되지 않았습니다. "
    "따라서 다른 리뷰에서 언급됐는지 여부를 판정하지 않았습니다.",
]
UNRESOLVED_CONDITIONS = [
    "",
    "### 추천 조건에서 보류된 부정 Opinion Unit",
    "",
    "아래 Unit은 부정 경험으로 추출됐지만 canonical aspect-status가 없어 대안 순위의 기피 조건에 "
    "포함하지 않았습니다.",
]
ALTERNATIVES_HEADING = ["", "## 대안 상품 추천", ""]
NO_NEGATIVE_INPUT = (
    "제출된 리뷰에서 부정적인 상품 속성-상태가 관찰되지 않아 대안 상품을 추천하지 않습니다."
)
NEGATIVE_UNRESOLVED = (
    "제출된 리뷰에서 부정적인 Opinion Unit {}개가 관찰됐지만, 정확한 mapping table match가 없어 "
    "canonical aspect-status로 확정되지 않았습니다. candidate 추정값은 근거 기반 대안 순위에 "
    "사용하지 않으므로 추천을 보류합니다."
)
NO_CANDIDATE = "부정 속성을 보완할 수 있는 카탈로그 근거가 있는 대안 상품이 없습니다."
CONDITIONS_FOUND = "제출된 리뷰에서 확인된 부정적인 속성-상태는 {}입니다."
BEST_ALTERNATIVE = (
    "제출된 부정 속성을 기피 조건으로 둘 때, 1순위 대안은 {}입니다. **weakness utility** {} 및 "
    "**experience similarity** {}를 3:1로 결합한 **weakness repair score** {}가 후보 중 가장 높기 "
    "때문입니다."
)
ALTERNATIVES_TABLE = [
    "",
    "정적 카탈로그 분석의 약점 보완 방식을 적용해, 제출된 부정 조건에 대한 weakness utility와 원본 "
    "상품의 리뷰 경험 유사도를 3:1로 결합했습니다.",
    "",
    "- **weakness utility**: 제출된 부정 조건에 대해 후보가 얼마나 유리한지를 나타내는 근거 "
    "점수(-1~1).",
    "- **experience similarity**: 원본 상품과의 리뷰 경험 유사도로, 약점 보완이 얼마나 유사한 맥락을 "
    "유지하는지 나타냅니다.",
    "- **weakness repair score**: weakness utility와 experience similarity를 3:1로 결합한 최종 순위 "
    "점수입니다.",
    "",
    "| rank | product | weakness utility | experience similarity | weakness repair score | "
    "recommendation reason |",
    "|---:|---|---:|---:|---:|---|",
]
