"""Catalogues: the canonical fields, techniques' rules and lookup tables that the operators read.

All are plain values; a user hands in others of the same shape."""

from __future__ import annotations

# Names that a canonical field goes by in logs.
FIELDS = {
    "process.name": ["Process Name", "New Process Name", "NewProcessName", "ProcessName", "Image", "Application Name"],
    "process.path": ["Process Path", "ProcessPath"],
    "process.id": ["Process ID", "ProcessId", "PID"],
    "process.command_line": ["Command Line", "CommandLine", "Process Command Line", "Command"],
    "parent.process.name": ["Parent Process Name", "ParentProcessName", "ParentImage"],
    "parent.process.path": ["Parent Process Path", "ParentProcessPath"],
    "parent.process.id": ["Parent Process ID", "ParentProcessId", "PPID"],
    "account.name": ["Account Name", "AccountName", "SubjectUserName", "User"],
    "user.domain": ["User Domain", "Account Domain", "SubjectDomainName"],
    "user.workstation": ["User Workstation", "Workstation Name", "WorkstationName"],
    "user.account_control": ["User Account Control"],
    "logon.id": ["Logon ID", "LogonId", "Subject Logon ID"],
    "logon.type": ["Logon Type", "LogonType"],
    "target.user.name": ["Target User Name", "TargetUserName"],
    "group.id": ["Group ID", "GroupId"],
    "event.id": ["Event ID", "EventID", "EventCode", "Event Code"],
    "event.message": ["Message"],
    "event.timestamp": ["Timestamp", "TimeCreated", "Event Time"],
    "host.name": ["Hostname", "Computer", "ComputerName", "Host"],
    "object.name": ["Object Name", "ObjectName", "TargetObject"],
    "object.type": ["Object Type", "ObjectType"],
    "object.server": ["Object Server", "ObjectServer"],
    "object.value_name": ["Object Value Name", "ObjectValueName", "Value Name"],
    "object.class": ["Class"],
    "handle.id": ["Handle ID", "HandleId"],
    "pipe.name": ["Pipe Name", "PipeName"],
    "operation.type": ["Operation Type", "OperationType"],
    "value.old": ["Old Value", "OldValue"],
    "value.old_type": ["Old Value Type", "OldValueType"],
    "value.new": ["New Value", "NewValue"],
    "value.new_type": ["New Value Type", "NewValueType"],
    "access.list": ["Accesses", "Access List", "AccessList"],
    "access.mask": ["Access Mask", "AccessMask"],
    "file.name": ["Filename", "File Name", "TargetFilename"],
    "file.path": ["File Path", "FilePath"],
    "file.directory": ["File Directory", "FileDirectory"],
    "service.name": ["Service Name", "ServiceName"],
    "service.image_path": ["Service File Name", "ImagePath"],
    "source.ip": ["Source Address", "SourceIp", "SrcIP", "Source IP"],
    "source.port": ["Source Port", "SourcePort"],
    "destination.ip": ["Destination Address", "DestinationIp", "DstIP", "Destination IP"],
    "destination.port": ["Destination Port", "DestinationPort"],
    "share.name": ["Share Name", "ShareName"],
    "script.block_text": ["ScriptBlockText", "Script Block Text"],
    "target.image": ["TargetImage", "Target Image"],
}
# Fields that hold lists, and what parts their items.
LISTS = {"access.list": "|"}
# Fields whose value is itself a log.
NESTED = ["event.message"]
# A name that its path gives when the log has the path alone.
DERIVED = {"parent.process.name": "parent.process.path"}
# The older name of a field.
LEGACY = {"process.name": "NewProcessName", "process.command_line": "CommandLine", "account.name": "SubjectUserName", "logon.id": "LogonId", "logon.type": "LogonType", "event.id": "EventID", "event.message": "Message", "event.timestamp": "Timestamp", "host.name": "Hostname", "object.name": "ObjectName", "access.list": "Accesses", "access.mask": "AccessMask", "file.name": "TargetFilename", "file.path": "FilePath", "service.name": "ServiceName", "service.image_path": "ImagePath", "source.ip": "SourceIp", "source.port": "SourcePort", "destination.ip": "DestinationIp", "destination.port": "DestinationPort", "share.name": "ShareName", "script.block_text": "ScriptBlockText", "target.image": "TargetImage"}
# Values that say nothing.
NON_INFORMATIVE = ["n/a", "-", "", "null sid", "null"]
# Rules as technique, name, tactic, required ids, forbidden ids, conditions (all must hold; in each any of field, pattern that must match, pattern that must not), least events, level.
RULES = [
    ('T1686.003', 'Windows Host Firewall', 'TA0112', ['4946', '4947', '4948', '4949', '4950', '4954', '5025'], ['5156', '5158'], [[('Message', '(?i)(rule (was )?(added|deleted|modified|changed)|setting.{0,30}changed|exception list|was restored to the default|service.{0,20}stopped)', None)]], 1, 'high'),
    ('T1685.001', 'Disable or Modify Windows Event Log', 'TA0112', ['4719'], [], [[('Message', '(?i)audit polic(y|ies).{0,40}changed', None)]], 1, 'high'),
    ('T1685.001', 'Disable or Modify Windows Event Log', 'TA0112', ['7040'], [], [[('Message', '(?i)Windows Event Log service was changed from .{0,30} to disabled', None)]], 1, 'high'),
    ('T1685', 'Disable or Modify Tools', 'TA0112', ['5001', '5010', '5012', '5101'], [], [[('Message', '(?i)(disabled|turned off|stopped)', None)]], 1, 'high'),
    ('T1059.001', 'PowerShell', 'TA0002', ['4104'], [], [[('script.block_text', '(?i)(scriptblock|script block)', None), ('event.message', '(?i)(scriptblock|script block)', None)]], 1, 'high'),
    ('T1059.003', 'Windows Command Shell', 'TA0002', ['4688', '1'], [], [[('process.name', '(?i)(?:^|\\\\)cmd\\.exe', None)]], 1, 'high'),
    ('T1053.005', 'Scheduled Task', 'TA0002', ['4698', '4699', '4700', '4702'], [], [], 1, 'high'),
    ('T1053.005', 'Scheduled Task', 'TA0002', ['4688', '1'], [], [[('process.name', '(?i)schtasks(\\.exe)?\\b', None)], [('process.command_line', '(?i)/(create|change)\\b', None)]], 1, 'high'),
    ('T1059.001', 'PowerShell', 'TA0002', ['4688', '1'], [], [[('process.name', '(?i)powershell(\\.exe)?\\b', None)], [('process.command_line', '(?i)(-enc\\b|-encodedcommand|downloadstring|downloadfile|\\biex\\b|invoke-expression|-executionpolicy\\s+bypass|-w(indowstyle)?\\s+hidden)', None)]], 1, 'high'),
    ('T1543.003', 'Windows Service', 'TA0003', ['7045', '4697'], [], [], 1, 'high'),
    ('T1003.001', 'LSASS Memory', 'TA0006', ['4656', '4663', '10'], [], [[('target.image', '(?i)lsass\\.exe', None), ('object.name', '(?i)lsass\\.exe', None)]], 1, 'high'),
    ('T1021.002', 'SMB/Windows Admin Shares', 'TA0008', ['5140', '5145'], [], [[('share.name', '(?i)(ADMIN\\$|C\\$|IPC\\$)', None)]], 1, 'high'),
    ('T1078', 'Valid Accounts', 'TA0001', ['4624'], [], [[('logon.type', '(?i)logon type:\\s*(3|10)', None)]], 1, 'medium'),
    ('T1018', 'Remote System Discovery', 'TA0007', ['4688', '1'], [], [[('process.name', '(?i)(?:^|\\\\)(net|net1|nltest|arp)\\.exe', None)]], 1, 'medium'),
    ('T1016', 'System Network Configuration Discovery', 'TA0007', ['4688', '1'], [], [[('process.name', '(?i)(?:^|\\\\)(ipconfig|netsh|route|arp|nbtstat)\\.exe', None)]], 1, 'medium'),
    ('T1057', 'Process Discovery', 'TA0007', ['4688', '1'], [], [[('process.name', '(tasklist\\.exe|qprocess\\.exe)', None), ('process.command_line', 'get-process', None)]], 1, 'medium'),
    ('T1082', 'System Information Discovery', 'TA0007', ['4688', '1'], [], [[('process.name', '(?i)(?:^|\\\\)(systeminfo|hostname|wmic)\\.exe', None)]], 1, 'medium'),
    ('T1083', 'File and Directory Discovery', 'TA0007', ['4688', '1'], [], [[('process.name', '(tree\\.com|where\\.exe)', None), ('process.command_line', '(dir /s|get-childitem -recurse)', None)]], 1, 'medium'),
    ('T1047', 'Windows Management Instrumentation', 'TA0002', ['4688', '1'], [], [[('process.name', '(?i)(?:^|\\\\)(wmic|wmiprvse)\\.exe', None)], [('process.command_line', '(?i)(process\\s+call\\s+create|/node:|node=)', None)]], 1, 'high'),
    ('T1218.010', 'Regsvr32', 'TA0005', ['4688', '1'], [], [[('process.name', '(?i)(?:^|\\\\)regsvr32\\.exe', None)], [('process.command_line', '(?i)(/i:|scrobj\\.dll|https?://|\\\\\\\\)', None)]], 1, 'high'),
    ('T1218.011', 'Rundll32', 'TA0005', ['4688', '1'], [], [[('process.name', '(?i)(?:^|\\\\)rundll32\\.exe', None)], [('process.command_line', '(?i)(javascript:|\\.dll\\s*,\\s*\\w+|url\\.dll|shell32\\.dll\\s*,\\s*shellexec)', None)]], 1, 'high'),
    ('T1204.002', 'Malicious File', 'TA0002', ['4688', '1'], [], [[('parent.process.name', '(?i)(winword|excel|powerpnt|outlook)\\.exe', None)], [('process.name', '(?i)(?:^|\\\\)(cmd|powershell|wscript|cscript|mshta|regsvr32|rundll32)\\.exe', None)]], 1, 'high'),
    ('T1566.001', 'Spearphishing Attachment', 'TA0001', ['4688', '1'], [], [[('parent.process.name', '(?i)outlook\\.exe', None)], [('process.name', '(?i)(?:^|\\\\)(cmd|powershell|wscript|cscript|mshta)\\.exe', None)]], 1, 'medium'),
    ('T1547.001', 'Registry Run Keys / Startup Folder', 'TA0003', ['4657', '12', '13', '11'], [], [[('object.name', '(?i)(\\\\CurrentVersion\\\\Run|\\\\CurrentVersion\\\\RunOnce|\\\\Start Menu\\\\Programs\\\\Startup)', None), ('file.name', '(?i)(\\\\CurrentVersion\\\\Run|\\\\CurrentVersion\\\\RunOnce|\\\\Start Menu\\\\Programs\\\\Startup)', None)]], 1, 'high'),
    ('T1543.003', 'Windows Service', 'TA0003', ['4657', '13'], [], [[('object.name', '(?i)\\\\Services\\\\[^\\\\]+\\\\ImagePath', None)]], 1, 'high'),
    ('T1136.001', 'Local Account', 'TA0003', ['4720'], [], [], 1, 'high'),
    ('T1098', 'Account Manipulation', 'TA0003', ['4728', '4732', '4756', '4738'], [], [], 1, 'high'),
    ('T1505.003', 'Web Shell', 'TA0003', ['11', '4663'], [], [[('file.name', '(?i)\\\\(inetpub\\\\wwwroot|wwwroot|htdocs)\\\\', None), ('file.path', '(?i)\\\\(inetpub\\\\wwwroot|wwwroot|htdocs)\\\\', None), ('process.command_line', '(?i)\\\\(inetpub\\\\wwwroot|wwwroot|htdocs)\\\\', None)], [('file.name', '(?i)\\.(aspx?|jsp|php)\\b', None)]], 1, 'high'),
    ('T1055', 'Process Injection', 'TA0004', ['8', '10'], [], [[('process.name', None, '(?i)(?:^|\\\\)(MsMpEng|CSFalconService|SentinelAgent|xagt)\\.exe')]], 1, 'medium'),
    ('T1055.001', 'Dynamic-link Library Injection', 'TA0004', ['8', '7'], [], [[('file.name', '(?i)\\.dll\\b', None)], [('file.name', '(?i)(\\\\users\\\\|\\\\temp\\\\|\\\\programdata\\\\|\\\\appdata\\\\)', None), ('file.path', '(?i)(\\\\users\\\\|\\\\temp\\\\|\\\\programdata\\\\|\\\\appdata\\\\)', None), ('process.command_line', '(?i)(\\\\users\\\\|\\\\temp\\\\|\\\\programdata\\\\|\\\\appdata\\\\)', None)]], 1, 'high'),
    ('T1055.012', 'Process Hollowing', 'TA0004', ['8'], [], [[('Message', '(?i)(NtUnmapViewOfSection|SetThreadContext|WriteProcessMemory)', None)]], 1, 'high'),
    ('T1003.002', 'Security Account Manager', 'TA0006', ['4688', '4656', '4663', '1'], [], [[('process.command_line', 'reg\\s+save\\s+hklm\\\\sam', None), ('object.name', '(\\\\config\\\\SAM\\b|HKLM\\\\SAM)', None), ('process.command_line', '(\\\\config\\\\SAM\\b|HKLM\\\\SAM)', None)]], 1, 'high'),
    ('T1110.001', 'Password Guessing', 'TA0006', ['4625'], [], [], 5, 'medium'),
    ('T1558.003', 'Kerberoasting', 'TA0006', ['4769'], [], [[('Message', '(?i)(0x17|rc4[-_ ]?hmac)', None)]], 1, 'high'),
    ('T1550.002', 'Pass the Hash', 'TA0008', ['4624'], [], [[('logon.type', '(?i)logon type:\\s*3', None)], [('Message', '(?i)(NtLmSsp|NTLM)', None)]], 1, 'medium'),
    ('T1021.001', 'Remote Desktop Protocol', 'TA0008', ['4624', '4778'], [], [[('logon.type', '(?i)logon type:\\s*10', None)]], 1, 'medium'),
    ('T1685.005', 'Clear Windows Event Logs', 'TA0112', ['1102', '104', '4688', '1'], [], [[('Message', '(audit log was cleared|log file was cleared)', None), ('process.command_line', '(wevtutil\\s+cl\\b|clear-eventlog)', None)]], 1, 'high'),
    ('T1070.003', 'Clear Command History', 'TA0112', ['4688', '4104', '1'], [], [[('process.command_line', '(?i)(clear-history|remove-item.*consolehost_history|set-psreadlineoption\\s+-historysavestyle\\s+savenothing)', None)]], 1, 'high'),
    ('T1564.003', 'Hidden Window', 'TA0005', ['4688', '4104', '400', '1'], [], [[('process.command_line', '(?i)-w(indowstyle)?\\s+hidden', None)]], 1, 'medium'),
    ('T1140', 'Deobfuscate/Decode Files or Information', 'TA0005', ['4688', '1'], [], [[('process.command_line', '(?i)certutil.*-decode', None)]], 1, 'high'),
    ('T1620', 'Reflective Code Loading', 'TA0005', ['4104'], [], [[('script.block_text', '(?i)(\\[reflection\\.assembly\\]::load|system\\.reflection\\.assembly)', None)]], 1, 'high'),
    ('T1105', 'Ingress Tool Transfer', 'TA0011', ['4688', '1'], [], [[('process.name', '(curl\\.exe|wget\\.exe)', None), ('process.command_line', '(certutil.*-urlcache|bitsadmin.*/transfer|invoke-webrequest|downloadfile)', None)]], 1, 'high'),
    ('T1071.001', 'Web Protocols', 'TA0011', ['3', '5156'], [], [[('destination.port', '(?i)destination port:\\s*(80|443|8080|8443)\\b', None)], [('file.name', '(?i)\\\\(users|programdata|temp|appdata)\\\\', None), ('file.path', '(?i)\\\\(users|programdata|temp|appdata)\\\\', None), ('process.command_line', '(?i)\\\\(users|programdata|temp|appdata)\\\\', None)]], 1, 'medium'),
    ('T1071.004', 'DNS', 'TA0011', ['22'], [], [[('Message', '(?i)query name:\\s*\\S{40,}', None)]], 1, 'medium'),
    ('T1560', 'Archive Collected Data', 'TA0009', ['4688', '1'], [], [[('process.name', '(?i)(?:^|\\\\)(rar|7z|7za|winrar|tar)\\.exe', None)], [('process.command_line', '(?i)(\\s-hp|\\s-p\\S|\\sa\\s+-|compress-archive)', None)]], 1, 'high'),
    ('T1074', 'Data Staged', 'TA0009', ['11', '4663'], [], [[('file.name', '(?i)\\\\(users\\\\public|programdata|windows\\\\temp)\\\\', None), ('file.path', '(?i)\\\\(users\\\\public|programdata|windows\\\\temp)\\\\', None), ('process.command_line', '(?i)\\\\(users\\\\public|programdata|windows\\\\temp)\\\\', None), ('object.name', '(?i)\\\\(users\\\\public|programdata|windows\\\\temp)\\\\', None)], [('file.name', '(?i)\\.(zip|rar|7z|cab|tar|gz)\\b', None), ('object.name', '(?i)\\.(zip|rar|7z|cab|tar|gz)\\b', None)]], 1, 'medium'),
    ('T1490', 'Inhibit System Recovery', 'TA0040', ['4688', '1'], [], [[('process.command_line', '(?i)(vssadmin.*delete\\s+shadows|wbadmin.*delete|bcdedit.*recoveryenabled\\s+no|bcdedit.*bootstatuspolicy\\s+ignoreallfailures)', None)]], 1, 'high'),
    ('T1486', 'Data Encrypted for Impact', 'TA0040', ['4688', '1'], [], [[('process.command_line', '(cipher\\s+/w|bcdedit.*safeboot)', None), ('file.name', '\\.(locked|encrypted|crypt)\\b', None)]], 1, 'medium'),
    ('T1489', 'Service Stop', 'TA0040', ['4688', '7040', '1'], [], [[('process.command_line', '(?i)(net\\s+stop\\s|sc\\s+(stop|config).*disabled|stop-service)', None)]], 1, 'medium'),
    ('T1686', 'Disable or Modify System Firewall', 'TA0112', ['4688', '1'], [], [[('process.command_line', '(?i)netsh.*(advfirewall|firewall).*(off|disable)', None)]], 1, 'high'),
    ('T1686', 'Disable or Modify System Firewall', 'TA0112', ['4946', '4947', '4948', '4949', '4950', '4954', '5025'], ['5156', '5158'], [[('Message', '(?i)(rule (was )?(added|deleted|modified|changed)|setting.{0,30}changed|exception list|was restored to the default|service.{0,20}stopped)', None)]], 1, 'high'),
]
# Rules that ask an analyst to look, without a technique.
REVIEW_RULES = [
    ('powershell_hidden_bypass', [[('Message', '(?i)executionpolicy\\s+bypass', None)], [('Message', '(?i)windowstyle\\s+hidden', None)]], 1),
    ('binary_in_user_writable_path', [[('Message', '(?i)\\\\users\\\\public\\\\[^\\\\\\s]+\\.exe', None)]], 1),
]
# Events as id: access class, whether the access took place, data components, fields that say most.
EVENTS = {
    '4656': ('read', False, ['File Access', 'Windows Registry Key Access'], ['object.name', 'object.type', 'access.list', 'access.mask', 'process.name', 'account.name']),
    '4657': ('write', True, ['Windows Registry Key Modification'], ['object.name', 'object.value_name', 'value.old', 'value.new', 'operation.type', 'process.name', 'account.name']),
    '4658': ('audit', True, [], ['handle.id', 'process.name']),
    '4660': ('delete', True, ['File Deletion', 'Windows Registry Key Deletion'], ['object.name', 'handle.id', 'process.name', 'account.name']),
    '4663': ('read', True, ['File Access', 'Windows Registry Key Access'], ['object.name', 'object.type', 'access.list', 'access.mask', 'process.name', 'account.name']),
    '4670': ('write', True, ['Active Directory Object Modification'], ['object.name', 'process.name', 'account.name']),
    '4624': ('auth', True, ['Logon Session Creation'], ['account.name', 'logon.type', 'source.ip', 'host.name', 'logon.id']),
    '4625': ('auth', True, ['Logon Session Creation'], ['account.name', 'logon.type', 'source.ip', 'host.name']),
    '4648': ('auth', True, ['Logon Session Creation'], ['account.name', 'process.name', 'host.name']),
    '4672': ('auth', True, [], ['account.name', 'logon.id']),
    '4673': ('audit', True, [], ['account.name', 'process.name']),
    '4634': ('auth', True, [], ['account.name', 'logon.id']),
    '4688': ('create', True, ['Process Creation'], ['process.name', 'process.command_line', 'parent.process.name', 'account.name']),
    '4689': ('audit', True, [], ['process.name', 'account.name']),
    '1': ('create', True, ['Process Creation'], ['process.name', 'process.command_line', 'parent.process.name', 'account.name']),
    '4720': ('create', True, ['User Account Creation'], ['account.name', 'user.domain']),
    '4726': ('delete', True, ['User Account Deletion'], ['account.name', 'user.domain']),
    '4732': ('write', True, ['User Account Modification'], ['account.name', 'group.id']),
    '4738': ('write', True, ['User Account Modification'], ['account.name', 'user.domain']),
    '7045': ('create', True, ['Service Creation'], ['service.name', 'service.image_path', 'account.name']),
    '4697': ('create', True, ['Service Creation'], ['service.name', 'service.image_path', 'account.name']),
    '4719': ('write', True, [], ['account.name', 'host.name']),
    '1102': ('delete', True, ['Windows Event Log Deletion'], ['account.name', 'host.name']),
    '5140': ('read', True, ['Network Share Access'], ['share.name', 'account.name', 'source.ip']),
    '5156': ('audit', True, ['Network Connection Creation'], ['source.ip', 'destination.ip', 'destination.port', 'process.name']),
    '5158': ('audit', True, [], ['source.ip', 'source.port', 'process.name']),
    '3': ('audit', True, ['Network Connection Creation'], ['process.name', 'destination.ip', 'destination.port']),
    '10': ('read', True, ['Process Access'], ['process.name', 'target.image', 'access.mask']),
    '11': ('create', True, ['File Creation'], ['process.name', 'file.name', 'file.path']),
    '13': ('write', True, ['Windows Registry Key Modification'], ['object.name', 'value.new', 'process.name']),
    '4104': ('create', True, ['Script Execution'], ['script.block_text', 'account.name', 'host.name']),
}
# Registry assets as path, level, family.
ASSETS = [
    ('HKLM\\SAM', 'critical', 'credential-hive'),
    ('HKLM\\SECURITY', 'critical', 'credential-hive'),
    ('HKLM\\SECURITY\\Policy\\Secrets', 'critical', 'lsa-secrets'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\Lsa', 'critical', 'lsa-config'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\Lsa\\Security Packages', 'critical', 'lsa-provider'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\Lsa\\OSConfig\\Security Packages', 'critical', 'lsa-provider'),
    ('HKCU\\Software\\Microsoft\\Terminal Server Client\\Servers', 'critical', 'saved-credentials'),
    ('HKCU\\Software\\Microsoft\\Terminal Server Client\\Default', 'critical', 'saved-credentials'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon\\DefaultPassword', 'critical', 'autologon-password'),
    ('HKCU\\Software\\SimonTatham\\PuTTY\\Sessions', 'critical', 'saved-credentials'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run', 'high', 'autorun-run'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunOnce', 'high', 'autorun-run'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunOnceEx', 'high', 'autorun-run'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunServices', 'high', 'autorun-run'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunServicesOnce', 'high', 'autorun-run'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run', 'high', 'autorun-run'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\RunOnce', 'high', 'autorun-run'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\RunServices', 'high', 'autorun-run'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\RunServicesOnce', 'high', 'autorun-run'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Policies\\Explorer\\Run', 'high', 'autorun-policy'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon', 'high', 'winlogon'),
    ('HKCU\\Software\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon', 'high', 'winlogon'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon\\Notify', 'high', 'winlogon'),
    ('HKCU\\Software\\Microsoft\\Windows NT\\CurrentVersion\\Windows\\Load', 'high', 'winlogon'),
    ('HKCU\\Software\\Microsoft\\Windows NT\\CurrentVersion\\Windows\\Run', 'high', 'winlogon'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Explorer\\Shell Folders', 'high', 'startup-folder'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\Shell Folders', 'high', 'startup-folder'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\User Shell Folders', 'high', 'startup-folder'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Windows\\AppInit_DLLs', 'high', 'appinit-dll'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Image File Execution Options', 'high', 'ifeo'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\AppCertDlls', 'high', 'appcert-dll'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\Session Manager\\BootExecute', 'high', 'boot-execute'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\Session Manager\\AppCertDlls', 'high', 'appcert-dll'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Services\\WinSock2\\Parameters', 'high', 'winsock-provider'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\Print\\Monitors', 'high', 'print-provider'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\Print\\Environments', 'high', 'print-provider'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\TimeProviders', 'high', 'time-provider'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\NetworkProvider\\Order', 'high', 'network-provider'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Services', 'high', 'service'),
    ('HKCU\\Software\\Classes\\CLSID', 'high', 'com-hijack'),
    ('HKCU\\Software\\Classes\\mscfile\\shell\\open\\command', 'high', 'com-hijack'),
    ('HKCU\\Software\\Classes\\Folder\\shell\\open\\command', 'high', 'com-hijack'),
    ('HKCU\\Software\\Classes\\ms-settings\\shell\\open\\command', 'high', 'uac-bypass'),
    ('HKCU\\Software\\Classes\\exefile\\shell\\open\\command', 'high', 'com-hijack'),
    ('HKCU\\Environment\\COR_PROFILER', 'high', 'cor-profiler'),
    ('HKCU\\Environment\\UserInitMprLogonScript', 'high', 'logon-script'),
    ('HKCU\\Control Panel\\Desktop\\SCRNSAVE.EXE', 'high', 'screensaver'),
    ('HKLM\\SOFTWARE\\Policies\\Microsoft\\Windows Defender', 'high', 'defender-policy'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows Defender', 'high', 'defender-policy'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Services\\EventLog', 'high', 'eventlog-config'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Services\\SharedAccess\\Parameters\\FirewallPolicy', 'high', 'firewall-policy'),
    ('HKLM\\SOFTWARE\\Policies\\Microsoft\\Windows\\WindowsUpdate', 'high', 'update-policy'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Policies\\System', 'high', 'uac-policy'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\SafeBoot', 'high', 'safeboot'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\WMI\\Security', 'high', 'wmi-security'),
    ('HKLM\\SOFTWARE\\Microsoft\\Active Setup\\Installed Components', 'high', 'active-setup'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\SilentProcessExit', 'high', 'silent-process-exit'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\SvcHost', 'high', 'svchost-group'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Windows\\LoadAppInit_DLLs', 'high', 'appinit-dll'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\App Paths', 'high', 'app-paths'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Control Panel\\Cpls', 'high', 'control-panel-cpl'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Policies\\Explorer\\Run', 'high', 'autorun-policy'),
    ('HKCR\\CLSID', 'high', 'com-hijack'),
    ('HKCR\\http\\shell\\open\\command', 'high', 'protocol-handler'),
    ('HKCU\\Software\\Policies\\Google\\Chrome\\ExtensionInstallForcelist', 'high', 'browser-extension'),
    ('HKCU\\Software\\Microsoft\\Office test\\Special\\Perf', 'high', 'office-persistence'),
    ('HKCU\\Software\\Microsoft\\Office\\16.0\\Outlook\\Profiles', 'high', 'office-persistence'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Policies\\System\\LocalAccountTokenFilterPolicy', 'high', 'token-filter-policy'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\WMI\\Autologger', 'high', 'eventlog-config'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Internet Settings\\ZoneMap', 'high', 'zone-policy'),
    ('HKLM\\SOFTWARE\\Microsoft\\Netsh', 'high', 'netsh-helper'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\AppCompatFlags\\Custom', 'high', 'app-shim'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\AppCompatFlags\\InstalledSDB', 'high', 'app-shim'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\SecurityProviders\\WDigest', 'high', 'wdigest'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Windows', 'high', 'appinit-dll'),
    ('HKCU\\Control Panel\\Desktop', 'high', 'screensaver'),
    ('HKLM\\SOFTWARE\\Microsoft\\Print\\Components', 'high', 'fileless-storage'),
    ('HKLM\\SOFTWARE\\Policies\\Microsoft\\Windows\\Installer\\AlwaysInstallElevated', 'high', 'installer-elevation'),
    ('HKCU\\Software\\Policies\\Microsoft\\Windows\\Installer\\AlwaysInstallElevated', 'high', 'installer-elevation'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\CrashControl', 'high', 'crashdump-policy'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Services\\LanmanServer\\Parameters', 'high', 'share-config'),
    ('HKCU\\Console', 'medium', 'console-config'),
    ('HKCR\\txtfile\\shell', 'high', 'file-association-hijack'),
    ('HKCR\\enc\\shell\\open\\command', 'high', 'file-association-hijack'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\Advanced', 'high', 'hidden-files'),
    ('HKEY_CURRENT_USER\\Software\\Microsoft\\Windows NT\\CurrentVersion\\Windows', 'high', 'appinit-dll'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\ICM\\Calibration', 'high', 'uac-bypass'),
    ('HKLM\\Software\\Microsoft\\Office test\\Special\\Perf', 'high', 'office-persistence'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Run', 'high', 'autorun-run'),
    ('HKCU\\Software\\Microsoft\\Windows NT\\CurrentVersion\\Run', 'high', 'autorun-run'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Print\\Printers', 'medium', 'print-config'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\Session Manager', 'medium', 'session-manager'),
    ('HKCU\\Environment', 'medium', 'environment'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\Terminal Server', 'medium', 'rdp-config'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Policies', 'medium', 'policy-config'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Internet Settings', 'medium', 'proxy-config'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Internet Settings', 'medium', 'proxy-config'),
    ('HKCU\\Software\\Microsoft\\Internet Explorer\\Privacy', 'medium', 'browser-history'),
    ('HKCU\\Software\\Microsoft\\Internet Explorer', 'medium', 'browser-config'),
    ('HKLM\\SOFTWARE\\Classes', 'medium', 'file-association'),
    ('HKCU\\Software\\Classes', 'medium', 'file-association'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Time Zones', 'noise', 'time-zone'),
    ('HKCU\\Software\\Classes\\Local Settings\\MuiCache', 'noise', 'muicache'),
    ('HKCU\\Control Panel\\International', 'noise', 'locale'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\RecentDocs', 'noise', 'recent-docs'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Themes', 'noise', 'theme'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Services\\W32Time', 'noise', 'time-service'),
    ('HKLM\\SOFTWARE\\Microsoft\\Cryptography\\MachineGuid', 'noise', 'machine-identity'),
    ('HKLM\\HARDWARE\\DESCRIPTION\\System', 'noise', 'hardware-info'),
    ('HKLM\\SYSTEM\\CurrentControlSet\\Control\\Nls\\Language', 'noise', 'locale'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\ProductName', 'noise', 'os-version'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Uninstall', 'noise', 'installed-software'),
    ('HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Uninstall', 'noise', 'installed-software'),
    ('HKLM\\SOFTWARE\\Microsoft\\.NETFramework', 'noise', 'runtime-version'),
    ('HKLM\\SOFTWARE\\WBEM\\WDM', 'noise', 'driver-inventory'),
    ('HKCU\\SOFTWARE\\Microsoft\\CTF', 'noise', 'input-framework'),
    ('HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Explorer\\User Shell Folders', 'high', 'startup-folder'),
]
# Trusted folders, and expected actors as asset family, processes, accounts.
TRUSTED = ['\\Windows\\System32', '\\Windows\\SysWOW64', '\\Windows\\WinSxS', '\\Windows\\servicing', '\\Program Files', '\\Program Files (x86)']
EXPECTED_ACTORS = [('service', ['trustedinstaller.exe', 'msiexec.exe', 'tiworker.exe'], ['system', 'nt authority\\system', 'localsystem'])]
# Spellings of registry hives, segments that mean nothing, segments of one meaning.
HIVES = {'HKLM': ['HKEY_LOCAL_MACHINE', '\\REGISTRY\\MACHINE', 'REGISTRY\\MACHINE', '<HKLM>'], 'HKCU': ['HKEY_CURRENT_USER', '\\REGISTRY\\USER', 'REGISTRY\\USER', '<HKCU>'], 'HKCR': ['HKEY_CLASSES_ROOT'], 'HKU': ['HKEY_USERS'], 'HKCC': ['HKEY_CURRENT_CONFIG']}
NOISE_SEGMENTS = ['WOW6432Node']
SEGMENT_PATTERNS = [('ControlSet[0-9]{3}', 'CurrentControlSet')]
# Bits of access masks as family: bit, name, class; and the family of an object type.
MASKS = {
    'registry': [(1, 'KEY_QUERY_VALUE', 'read'), (2, 'KEY_SET_VALUE', 'write'), (4, 'KEY_CREATE_SUB_KEY', 'write'), (8, 'KEY_ENUMERATE_SUB_KEYS', 'read'), (16, 'KEY_NOTIFY', 'read'), (32, 'KEY_CREATE_LINK', 'write')],
    'standard': [(65536, 'DELETE', 'write'), (131072, 'READ_CONTROL', 'read'), (262144, 'WRITE_DAC', 'write'), (524288, 'WRITE_OWNER', 'write'), (1048576, 'SYNCHRONIZE', 'read')],
    'file': [(1, 'FILE_READ_DATA', 'read'), (2, 'FILE_WRITE_DATA', 'write'), (4, 'FILE_APPEND_DATA', 'write'), (32, 'FILE_EXECUTE', 'read'), (64, 'FILE_DELETE_CHILD', 'write'), (128, 'FILE_READ_ATTRIBUTES', 'read'), (256, 'FILE_WRITE_ATTRIBUTES', 'write')],
    'process': [(16, 'PROCESS_VM_READ', 'read'), (32, 'PROCESS_VM_WRITE', 'write'), (8, 'PROCESS_VM_OPERATION', 'write'), (1024, 'PROCESS_QUERY_INFORMATION', 'read')],
}
OBJECT_TYPES = {'key': 'registry', 'registry': 'registry', 'file': 'file', 'directory': 'file', 'process': 'process', 'token': 'standard'}
# Names whose words don't tell the bit, without blanks, underscores and dashes.
ACCESS_ALIASES = {'notifyaboutchangestokeys': 'KEY_NOTIFY'}
# Log sources by id: single ids first, then ranges.
SOURCE_IDS = {'4104': 'PowerShell operational', '400': 'PowerShell classic', '403': 'PowerShell classic', '104': 'PowerShell classic', '1102': 'Windows Security'}
SOURCE_RANGES = [(1, 30, 'Sysmon'), (4000, 5999, 'Windows Security'), (7000, 7999, 'Windows System')]
# Phrases of a control at work, and of one broken.
ENFORCING = ['\\bhas permitted\\b', '\\bpermitted\\b', '\\ballowed\\b', '\\bwas allowed\\b', '\\bblocked\\b', '\\bdenied\\b', '\\bprevented\\b', '\\bquarantined\\b', '\\baudit success\\b', '\\bsuccess audit\\b']
BREAKING = ['\\bdisabled\\b', '\\bturned off\\b', '\\bstopped\\b', '\\bshut down\\b', '\\bbypass(ed)?\\b', '\\bdeleted\\b', '\\bremoved\\b', '\\bcleared\\b', '\\bwas changed\\b', '\\bhas been made to\\b', '\\brule (added|deleted|modified|changed)\\b', '\\bexception list\\b', '\\baudit polic(y|ies) (was |were )?changed\\b', '\\bsetting.{0,30}changed\\b', '\\bunloaded\\b', '\\btampered\\b']
