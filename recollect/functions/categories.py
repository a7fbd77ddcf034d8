"""The category of an older, freely named one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in order of precedence with the words and the tags that speak for each; the last is the rest.
SIGNALS = {
    "safety_data_integrity": r"safety|security|secret|integrity|data[_ -]?loss|destructive|protection|safe[_ -]?guard|安全|完整性|数据丢失|破坏性|机密",
    "applicability_limitation": r"applicab|limit|scope|boundary|uncertain|caveat|exception|compatib|rollout|truncat|interpretation|适用|限制|范围|边界|不确定|兼容|截断",
    "preference_constraint": r"preference|constraint|decision|requirement|policy|instruction|user[_ -]?(?:request|decision|requirement)|goal|偏好|约束|决定|要求|规则|指令|目标",
    "architecture_contract": r"architect|api|contract|invariant|schema|state[_ -]?machine|identity|hierarch|serializ|structure|design|artifact|format|coordinate|geometry|wiring|binding|composition|dsl|model|架构|契约|不变量|身份|结构|格式|坐标|模型",
    "failure_recovery_hazard": r"failure|recovery|repair|hazard|diagnos|troubleshoot|pitfall|error|recurrence|cleanup|失败|恢复|修复|故障|诊断|清理",
    "workflow_environment_toolchain": r"workflow|procedure|verification|evaluation|build|install|configur|environment|tooling|operation|protocol|process|execution|delivery|publication|test|validation|editing|synchron|migration|maintenance|governance|implementation|method|planning|status|state|outcome|behavior|result|observation|discovery|input|interaction|render|preview|session|repository|spreadsheet|resource|runtime|telemetry|preflight|development|project|movement|physics|material|camera|animation|ui|工作流|流程|验证|评估|构建|安装|配置|环境|工具|操作|执行|交付|维护|治理|实现|状态|结果|输入|交互|渲染|会话|仓库|运行",
}
TAGS = {
    "safety_data_integrity": ("security_boundary", "data_loss_risk", "irreversible_operation"),
    "applicability_limitation": ("limitation", "negation", "applicability_correction", "exception"),
    "preference_constraint": ("user_decision", "stable_preference", "constraint"),
    "architecture_contract": ("architecture_invariant", "api_contract"),
    "failure_recovery_hazard": ("failure_root_cause", "effective_repair", "recovery_procedure", "recurrence_hazard"),
    "workflow_environment_toolchain": ("expensive_rediscovery",),
}
REST = "durable_reference"


def categories(named: Column, tags: Column) -> Column:
    """All categories that a name or its tags speak for, by precedence; a controlled name is its own alone, and the rest
    where nothing speaks. The name is trimmed and lower-cased, without the compatibility normal form, which Spark has not;
    null names and tags say nothing."""
    plain = F.lower(F.trim(named))
    spoken = [F.when(F.coalesce(plain.rlike(words), F.lit(False)) | F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, TAGS[c]))), F.lit(False)), F.lit(c)) for c, words in SIGNALS.items()]
    found = F.array_compact(F.array(*spoken))
    return F.when(named.isin(*SIGNALS, REST), F.array(named)).when(F.size(found) > 0, found).otherwise(F.array(F.lit(REST)))
